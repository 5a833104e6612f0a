"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(member | class, history) * P(token | class and member).
A class has ``MEMBERS`` members.  The ``FREQUENT`` commonest tokens are members of their own, all others
are dealt to the remaining members by a hash of their last three bytes; the end of a text is a member
too.  Both softmaxes are log-linear in n-gram and skip features of the preceding words themselves (the
first, second and third word back, the last two together; for members the first, the second and both,
each together with the class),
hashed into a weight table of fixed size.  Within a member tokens have discounted relative frequencies
from the counts of the whole training corpus; what the discount takes away, set by the numbers of
tokens seen once and twice, is the share of unseen tokens, which count as one per member.

Training is synchronous: tasks add up observed and expected feature counts (the two halves of the
gradient) in whole numbers, the driver makes a scaled gradient step on the table.  The first step is
the one from the uniform model, whose expected counts need no pass.  Each further round takes another
part of the training documents, so that every token is evaluated once.  Expected counts are estimated
without bias by a draw per token from each of the model's softmaxes, seeded by the token's history
and place: the same texts give the same model, however they are dealt to tasks.

Texts are tokenised once, into chunks of about 4 MB that hold each distinct token once and the sequence
as local numbers.  Only the chunks' distinct tokens travel to be counted, packed by ranges of hashes, and
their counts travel back; no vocabulary is ever broadcast or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, PrefixHash, arrow_bytes, bound_batches, lowered, materialize, mix, portions, tidy, text_or_empty, word_spans
from .quality import add_blocks

CLASSES, MEMBERS, FREQUENT = 64, 64, 2048
#: The end's number; numbers from FREQUENT to END - 1 are those of hashed endings.
END = CLASSES * MEMBERS - 1
ENDINGS = END - FREQUENT
CLASS_BITS, MEMBER_BITS = 13, 14
#: First rows of the class features, of the members' constants and of the members' features; row 0 is the classes' constant.
CLASS_ROWS, CONSTANT_ROWS, MEMBER_ROWS = 64, 64 + (1 << CLASS_BITS), 128 + (1 << CLASS_BITS)
ROWS, BLOCK_ROWS = MEMBER_ROWS + (1 << MEMBER_BITS), 64
SEED, PORTION, CHUNK, SLICE = 41, 1 << 21, 1 << 22, 1 << 12
ROUNDS = 4
#: Distinct tokens of chunks that one task counts at once.
COUNTED = 250_000
#: Observations that the prior counts for in the first step, and the damping of the further ones.
SMOOTHING, DAMPING = 10, 10
#: Share of a step that each of the features of one history takes.
STEP = 0.25
#: Odd multipliers of the hashed features.
FACTORS = mix(np.arange(1, 13, dtype=np.uint64)) | np.uint64(1)
ONE = np.int32(1)
#: The words that stand before a text and at its end.
START, END_WORD = np.uint64(0x5354415254), np.uint64(0x454E44)


def in_planes(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed bytes, all low bytes first, then the higher ones."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes[: 8 if planes[4:].any() else 4].tobytes(), 1)


def from_planes(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(-1, count)
    wide = np.ascontiguousarray(planes.T)
    return wide.view("<i8" if len(planes) == 8 else "<i4").ravel().astype(np.int64)


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, a place of each, the number of each place's value, and how often each occurs."""
    order = np.argsort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[order[1:]], values[order[:-1]], out=new[1:])
    cut = np.flatnonzero(new)
    local = np.empty(len(values), np.int32)
    local[order] = np.cumsum(new, dtype=np.int32) - 1
    return values[order[cut]], order[cut], local, np.diff(np.append(cut, len(values)))


CHUNK_SCHEMA = "chunk long, ids array<{}>, held array<boolean>, part int, sizes array<int>, n int, tokens binary, words binary, endings binary, seen binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts of one part each."""
    task, number = TaskContext.get().partitionId(), 0
    parted = ((k, batch.filter(pc.equal(batch.column("_part"), k))) for batch in batches for k in pc.unique(batch.column("_part")).to_pylist())
    for part, batch in parted:
        body, offsets = arrow_bytes(batch.column("_text"))
        held = batch.column("_held").to_numpy(zero_copy_only=False)
        for lo, hi in portions(offsets, CHUNK):
            hashes, endings, counts = [], [], []
            base = offsets[lo : hi + 1]
            for a, b in portions(base, PORTION):
                at = base[a : b + 1]
                text = lowered(body[at[0] : at[-1]])
                start, end, row = word_spans(text, at - at[0], SPACED_WORD)
                hashed = PrefixHash(text, SEED)
                hashes.append(hashed.of(start, end))
                endings.append((hashed.of(np.maximum(start, end - 3), end) % np.uint64(ENDINGS)).astype(np.int16))
                counts.append(np.bincount(row, minlength=b - a))
            every, ending, count = np.concatenate(hashes), np.concatenate(endings), np.concatenate(counts)
            distinct, first, local, often = grouped(every)
            order = np.argsort(-often, kind="stable")  # frequent tokens have small numbers, which pack well
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            local, distinct, first = place[local], distinct[order], first[order]
            seen = np.bincount(local[np.repeat(~held[lo:hi], count)], minlength=len(distinct))
            whole = lambda c, lo=lo, n=hi - lo: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.slice(lo, n))
            sizes = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.array(count, pa.int32()))
            values = (in_planes(local), distinct.tobytes(), ending[first].astype("<i2").tobytes(), in_planes(seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number], pa.int64()), whole(batch.column("_id")), whole(batch.column("_held"))]
                + [pa.array([part], pa.int32()), sizes, pa.array([len(distinct)], pa.int32())] + [pa.array([v], pa.binary()) for v in values],
                names=["chunk", "ids", "held", "part", "sizes", "n", "tokens", "words", "endings", "seen"],
            )
            number += 1


# ---------------------------------------------------------------- counting


def ranged(words: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of tokens by range of hashes, and where each of the ``ranges`` begins in it."""
    of = ((words >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(ranges + 1, dtype=np.uint64))


def _dealt(ranges: int):
    """Each chunk's distinct tokens, one row per range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, endings = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["endings"], "<i2")
                order, cut = ranged(words, ranges)
                words, endings, seen = words[order], endings[order], from_planes(row["seen"], row["n"])[order]
                some = np.flatnonzero(np.diff(cut)).tolist()
                pieces = [slice(cut[k], cut[k + 1]) for k in some]
                columns = ([words[p].tobytes() for p in pieces], [endings[p].tobytes() for p in pieces], [in_planes(seen[p]) for p in pieces])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64())] + [pa.array(c, pa.binary()) for c in columns],
                    names=["range", "chunk", "words", "endings", "seen"],
                )

    return run


def merged_stats(parts: list[dict]) -> dict:
    """Sums of counts, and the commonest tokens of all parts (of equals the smaller hashes)."""
    top = np.concatenate([p["top"] for p in parts], axis=1)
    order = np.lexsort((top[0], -top[1]))[:FREQUENT]
    return {"top": top[:, order], "tokens": sum(p["tokens"] for p in parts), "types": sum(p["types"] for p in parts), "few": sum(p["few"] for p in parts)}


def packed_stats(stats: dict) -> bytes:
    return zstandard.compress(np.concatenate([stats[k].astype("<i8").ravel() for k in ("tokens", "types", "few", "top")]).tobytes(), 1)


def unpacked_stats(data: bytes) -> dict:
    flat = np.frombuffer(zstandard.decompress(data), "<i8")
    return {"tokens": flat[:ENDINGS], "types": flat[ENDINGS : 2 * ENDINGS], "few": flat[2 * ENDINGS : 2 * ENDINGS + 2], "top": flat[2 * ENDINGS + 2 :].reshape(3, -1)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corpus counts of each row's tokens, in their order, and a row (chunk -1) of what the tokens add up to."""
    rows = [r for batch in batches for r in batch.to_pylist()]  # about COUNTED tokens
    if not rows:
        return
    words, endings = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("words", np.uint64), ("endings", "<i2")))
    sizes = [len(r["words"]) // 8 for r in rows]
    seen = np.concatenate([from_planes(r["seen"], n) for r, n in zip(rows, sizes, strict=True)])
    distinct, first, local = np.unique(words, return_index=True, return_inverse=True)
    total = np.bincount(local, seen, len(distinct)).astype(np.int64)
    counts, at = total[local], np.concatenate(([0], np.cumsum(sizes)))
    for lo in range(0, len(rows), 256):
        some = range(lo, min(lo + 256, len(rows)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[k]["chunk"] for k in some], pa.int64()), pa.array([rows[k]["range"] for k in some], pa.int32())]
            + [pa.array([in_planes(counts[at[k] : at[k + 1]]) for k in some], pa.binary())],
            names=["chunk", "range", "counts"],
        )
    known = total > 0
    distinct, kind, total = distinct[known], endings[first][known], total[known]
    order = np.lexsort((distinct, -total))[:FREQUENT]
    stats = {
        "tokens": np.bincount(kind, total, ENDINGS).astype(np.int64), "types": np.bincount(kind, minlength=ENDINGS),
        "few": np.array([(total == 1).sum(), (total == 2).sum()]), "top": np.stack((distinct[order].view(np.int64), total[order], kind[order].astype(np.int64))),
    }
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1], pa.int64()), pa.array([0], pa.int32()), pa.array([packed_stats(stats)], pa.binary())], names=["chunk", "range", "counts"]
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for data in batch.column("counts").to_pylist():
            held = merged_stats([unpacked_stats(data)] + ([held] if held else []))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([packed_stats(held)], pa.binary())], names=["counts"])


def count_tokens(chunks: DataFrame) -> tuple[DataFrame, dict, int]:
    """(chunk, range, counts) of all chunks, the totals, and the number of ranges of hashes."""
    spark = chunks.sparkSession
    ranges = max(1, -(-int(chunks.agg(F.sum("n")).first()[0] or 0) // COUNTED))
    tasks = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = chunks.select("chunk", "n", "words", "endings", "seen")
    dealt = dealt.mapInArrow(tidy(_dealt(ranges)), "range int, chunk long, words binary, endings binary, seen binary")
    counted = materialize(dealt.repartition(tasks, "range").mapInArrow(tidy(_counted), "chunk long, range int, counts binary"), "counted")
    stats = counted.where("chunk = -1").select("counts")
    while tasks > 64:  # at most 64 rows of fixed size come to the driver
        tasks = -(-tasks // 64)
        stats = materialize(stats.repartition(tasks).mapInArrow(tidy(_merged), "counts binary"), "stats")
    found = [unpacked_stats(r.counts) for r in stats.collect()]
    none = {"top": np.zeros((3, 0), np.int64), "tokens": np.zeros(ENDINGS, np.int64), "types": np.zeros(ENDINGS, np.int64), "few": np.zeros(2, np.int64)}
    return counted.where("chunk >= 0"), merged_stats([none, *found]), ranges


# ---------------------------------------------------------------- the model


def numbers_of(words: np.ndarray, endings: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Class and member (class * MEMBERS + member) of each distinct token, and last of the end."""
    out = np.append(FREQUENT + endings.astype(np.int64), END)
    if len(frequent):
        order = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent[order], words), len(frequent) - 1)
        own = np.flatnonzero(frequent[order][at] == words)
        out[own] = order[at][own]
    return out


class Sequence:
    """Of some of a chunk's texts: the tokens' local numbers (the last is the end), their words, places and histories."""

    def __init__(self, row: dict, keep: np.ndarray | None = None) -> None:
        self.words = np.frombuffer(row["words"], np.uint64)
        sizes = np.array(row["sizes"], np.int64)
        local = from_planes(row["tokens"], int(sizes.sum()))
        if keep is not None:
            local, sizes = local[np.repeat(keep, sizes)], sizes[keep]
        ends = np.cumsum(sizes + 1) - 1
        self.local = np.full(len(local) + len(sizes), len(self.words), np.int64)
        inside = np.ones(len(self.local), bool)
        inside[ends] = False
        self.local[inside] = local
        self.begin = ends - sizes
        self.word = np.append(self.words, END_WORD)[self.local]
        self.place = np.arange(len(self.local)) - np.repeat(self.begin, sizes + 1)
        self.history = []
        for back in (1, 2, 3):
            before = np.full(len(self.local), START)
            before[back:] = self.word[:-back]
            before[self.place < back] = START  # nothing is seen across the beginning of a text
            self.history.append(before)

    def __len__(self) -> int:
        return len(self.local)


def feature_rows(history: list[np.ndarray], classes: np.ndarray | None) -> list[np.ndarray]:
    """Weight rows of the class softmax (without ``classes``) or of the softmax over members."""
    one, two, three = history
    k = FACTORS
    if classes is None:
        shift, first = np.uint64(64 - CLASS_BITS), np.uint64(CLASS_ROWS)
        constant = np.zeros(len(one), np.int64)
        hashed = [one * k[0], two * k[1], three * k[2], one * k[3] + two * k[4]]
    else:
        shift, first = np.uint64(64 - MEMBER_BITS), np.uint64(MEMBER_ROWS)
        constant = CONSTANT_ROWS + classes
        salt = classes.astype(np.uint64) * k[5]
        hashed = [one * k[6] + salt, two * k[7] + salt, one * k[8] + two * k[9] + salt]
    return [constant, *(((h >> shift) + first).astype(np.int64) for h in hashed)]


def logits_of(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    logits = weights[rows[0]]
    part = np.empty_like(logits)
    for r in rows[1:]:
        logits += np.take(weights, r, axis=0, out=part, mode="clip")
    return np.clip(logits, -40, 40, out=logits)


def likelihoods(weights: np.ndarray, rows: list[np.ndarray], true: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the true choices."""
    logits = logits_of(weights, rows)
    chosen = logits[np.arange(len(true)), true]
    return chosen - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))


UP_TO = np.triu(np.ones((CLASSES, CLASSES), np.float32))


def drawn(logits: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One choice of each row by its probabilities; ``u`` from 0 to 1."""
    cumulated = np.exp(logits, out=logits) @ UP_TO
    below = cumulated <= (u * cumulated[:, -1])[:, None]
    return np.minimum(np.bitwise_count(np.packbits(below, axis=1).view(np.uint64).ravel()).astype(np.int64), logits.shape[1] - 1)


def both_softmaxes(history: list[np.ndarray], numbers: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Feature rows and true choice, for classes and for members."""
    classes, members = numbers // MEMBERS, numbers % MEMBERS
    yield feature_rows(history, None), classes
    yield feature_rows(history, classes), members


def feature_counts(sequence: Sequence, numbers: np.ndarray, weights: np.ndarray | None, seen: np.ndarray, expected: np.ndarray) -> None:
    """Adds to flat tables of ROWS x CLASSES numbers: observed counts and a draw of the model per token.

    Without weights ``expected`` gets how often a member feature met each class.
    """
    for lo in range(0, len(sequence), SLICE):
        some = slice(lo, lo + SLICE)
        history = [h[some] for h in sequence.history]
        place = mix(sequence.word[some] * FACTORS[11] + history[0] * FACTORS[0] + history[1] * FACTORS[1] + sequence.place[some].astype(np.uint64))
        given = None
        for rows, true in both_softmaxes(history, numbers[sequence.local[some]]):
            at = [r * CLASSES for r in rows]
            for r in at:
                np.add.at(seen, r + true, ONE)
            if weights is not None:
                draw = drawn(logits_of(weights, rows), (place >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24))
                for r in at:
                    np.add.at(expected, r + draw, ONE)
            elif given is not None:
                for r in at[1:]:
                    np.add.at(expected, r + given, ONE)
            place, given = mix(place), true


def _summed(frequent: np.ndarray, weights):
    """Blocks of the two tables of ``feature_counts`` over training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if weights is None else weights.value
        seen, expected = (np.zeros(ROWS * CLASSES, np.int32) for _ in range(2))  # of one task
        for batch in batches:
            for row in batch.to_pylist():
                keep = ~np.array(row["held"], bool)
                if keep.any():
                    sequence = Sequence(row, keep)
                    feature_counts(sequence, numbers_of(sequence.words, np.frombuffer(row["endings"], "<i2"), frequent), table, seen, expected)
        blocks = np.concatenate((seen, expected)).reshape(-1, BLOCK_ROWS * CLASSES)
        for k in np.flatnonzero(blocks.any(axis=1)).tolist():
            data = zstandard.compress(blocks[k].astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["block", "sums"])

    return run


def gathered(chunks: DataFrame, frequent: np.ndarray, part: int | None, weights) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected counts of all tasks: ROWS x CLASSES numbers each, at any corpus size."""
    schema = "block int, sums binary"
    total = np.zeros((2 * ROWS // BLOCK_ROWS, BLOCK_ROWS * CLASSES), np.int64)
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = chunks if part is None else chunks.where(F.col("part") == part)
    sums = some.select("held", "sizes", "tokens", "words", "endings").mapInArrow(tidy(_summed(frequent, weights)), schema)
    for r in sums.repartition(tasks, "block").mapInArrow(tidy(add_blocks), schema).collect():
        total[r.block] += np.frombuffer(zstandard.decompress(r.sums), "<i8")
    seen, expected = total.reshape(2, ROWS, CLASSES).astype(np.float64)
    return seen, expected


def first_step(seen: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Constants by relative frequency, and the features' step from the model that has only those.

    ``met`` tells how often a member feature met each class: what the constants alone expect of it.
    """
    weights = np.zeros((ROWS, CLASSES), np.float32)
    features, members = slice(CLASS_ROWS, CONSTANT_ROWS), slice(MEMBER_ROWS, ROWS)
    prior = (seen[0] + 0.5) / (seen[0] + 0.5).sum()
    inner = seen[CONSTANT_ROWS:MEMBER_ROWS] + 0.5
    inner /= inner.sum(axis=1, keepdims=True)
    weights[0], weights[CONSTANT_ROWS:MEMBER_ROWS] = np.log(prior), np.log(inner)
    expected = seen[features].sum(axis=1, keepdims=True) * prior, met[members] @ inner
    for rows, e in zip((features, members), expected, strict=True):
        n = np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        weights[rows] = np.where(e > 0, STEP * np.log((seen[rows] + SMOOTHING * e / n + 1e-9) / (e + SMOOTHING * e / n + 1e-9)), 0)
    return weights


def stepped(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A gradient step, scaled by the counts that a weight has."""
    return (weights + (seen - expected) / (0.5 * (seen + expected) + DAMPING) * STEP).astype(np.float32)


def train(chunks: DataFrame, frequent: np.ndarray, rounds: int) -> np.ndarray:
    """The weights after the first step and ``rounds`` rounds over the parts of the training texts."""
    context = chunks.sparkSession.sparkContext
    weights = first_step(*gathered(chunks, frequent, None, None))
    for k in range(rounds):
        shared = context.broadcast(weights)
        weights = stepped(weights, *gathered(chunks, frequent, k, shared))
        shared.unpersist()
    return weights


def scores_of(sequence: Sequence, model: dict, endings: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of the tokens, by add-one frequencies and by the model; ``known`` are the distinct tokens' counts."""
    known = np.append(known, model["ends"])
    numbers = numbers_of(sequence.words, endings, model["frequent"])
    own = (numbers < FREQUENT) | (numbers == END)
    group = np.where(own, 0, numbers - FREQUENT)
    tokens, types = model["tokens"][group], model["types"][group]
    n, discount = np.maximum(tokens, 1), model["discount"]
    unseen = np.where(types > 0, discount * types / n, 1.0)
    inner = np.where(own, 0.0, np.log10(np.where(known > 0, (known - discount) / n, unseen)))
    base = np.log10((known + 1) / (model["n"] + model["v"] + 1))
    score = inner[sequence.local]
    for lo in range(0, len(sequence), SLICE):
        some = slice(lo, lo + SLICE)
        for rows, true in both_softmaxes([h[some] for h in sequence.history], numbers[sequence.local[some]]):
            score[some] += likelihoods(model["weights"], rows, true) / np.log(10)
    return base[sequence.local], score


def _scored(model, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("n", "sizes", "tokens", "words", "endings", "counts")}
                sequence = Sequence(row)
                order, cut = ranged(sequence.words, ranges)
                known = np.zeros(row["n"], np.int64)
                for x in row["counts"] or ():
                    at = order[cut[x["range"]] : cut[x["range"] + 1]]
                    known[at] = from_planes(x["counts"], len(at))
                sums = [np.add.reduceat(x, sequence.begin) for x in scores_of(sequence, m, np.frombuffer(row["endings"], "<i2"), known)]
                is_known = np.append(known, m["ends"])[sequence.local] > 0
                sums.append(np.add.reduceat(is_known.astype(np.int64), sequence.begin))
                sizes = np.array(row["sizes"], np.int64) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[k].values, batch.column("held")[k].values, pa.array(sizes), pa.array(sums[2]),
                        pa.array(np.full(len(sizes), m["n"])), pa.array(sums[0]), pa.array(sums[1]),
                    ],
                    names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def model_of(chunks: DataFrame, stats: dict, rounds: int) -> dict:
    """What scoring needs of the whole corpus; its size is fixed."""
    top = stats["top"]
    tokens, types = stats["tokens"].copy(), stats["types"].copy()
    np.subtract.at(tokens, top[2], top[1])  # frequent tokens are members of their own
    np.subtract.at(types, top[2], 1)
    ends = int(chunks.select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0)
    once, twice = stats["few"].tolist()
    frequent = top[0].view(np.uint64)
    return {
        "frequent": frequent, "weights": train(chunks, frequent, rounds), "tokens": tokens, "types": types, "ends": ends,
        "discount": min(0.95, max(0.05, once / max(1, once + 2 * twice))),
        "n": int(stats["tokens"].sum()) + ends, "v": int(stats["types"].sum()) + (ends > 0),
    }


def score_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, rounds: int = ROUNDS
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are runs without white space, A-Z lower-cased, and one end per text.  Training texts are
    those whose crc32(id as text) mod ``folds`` is not ``held_fold``.  base_score is the add-one
    unigram log10 probability, score the model's.  Null and empty texts consist of their end; null
    ids count as the empty text for the fold; repeated rows are learnt and scored each; with nothing
    to learn from all counts are zero; an empty table stays empty.  Other columns play no part.
    """
    spark = df.sparkSession
    bound_batches(spark)
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    part = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col), F.length(text_or_empty(text_col))), F.lit(max(1, rounds))).cast("int")
    source = df.select(F.col(id_col).alias("_id"), fold.alias("_held"), part.alias("_part"), text_or_empty(text_col).alias("_text"))
    kind = dict(source.dtypes)["_id"]
    chunks = materialize(source.mapInArrow(tidy(_chunked), CHUNK_SCHEMA.format(kind)), "chunks")
    counted, stats, ranges = count_tokens(chunks)
    model = spark.sparkContext.broadcast(model_of(chunks, stats, rounds))
    counts = counted.groupBy("chunk").agg(F.collect_list(F.struct("range", "counts")).alias("counts"))
    schema = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ready = chunks.drop("part", "seen").join(counts, "chunk", "left")
    return ready.mapInArrow(tidy(_scored(model, ranges)), schema).withColumnRenamed("_id", id_col)

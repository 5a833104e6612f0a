"""Exact substring deduplication by bucket-pointer refinement of suffix buckets.

Every byte that lies in a string of ``min_length`` bytes which starts anywhere else too is removed.

How it stays distributed.  A window is a string of ``min_length`` bytes; its anchor is the place of
the smallest 32-gram hash in it, so equal windows have equal anchors at equal places.  Neighbouring
windows with one anchor form a block.  All windows of one block share a guaranteed core, and only
blocks with equal cores can hold equal windows: blocks are bucketed by the hash of their core.
A bucket of one block is done (nothing repeats), so is one whose blocks are all equal (everything
repeats); that, and that a block has copies, is told by two 64-bit hashes of its bytes.  For the rest
one text per distinct block is gathered, and the suffixes in the bucket are refined: 4-gram buckets
first, each refined by sorting on the bucket pointers of later offsets, which refinements before it in
the same round have already updated, until buckets stand for ``min_length`` bytes.  A bucket with more
distinct blocks than ``bucket_limit`` is first split into finer blocks (an eighth of the windows each),
again and again, down to single windows, where equality of hashes decides alone.  A text may have
2^27 bytes at most; a longer one is refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import SPACED_WORD, PrefixHash, arrow_bytes, bound_batches, carried_name, discard, materialize, portions, row_key, tidy, text_or_empty

GRAM, PORTION, SEED_CORE, SEED_BLOCK = 32, 1 << 21, 11, 12
#: Bytes of the first buckets, and shares in which a round refines the open ones.
Q, SHARES = 4, 8
BLOCK_SCHEMA = "_k1 long, _k2 long, first int, n_windows int, left int, core long, block long"
CONTEXT_SCHEMA = "core long, block long, copies long, _k1 long, _k2 long, first int, n_windows int, left int, body binary"
RUN_SCHEMA = "_k1 long, _k2 long, lo int, hi int"
MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", "n_passages", "passage_bytes")


def window_blocks(body: np.ndarray, offsets: np.ndarray, length: int, step: int) -> tuple[np.ndarray, ...]:
    """Blocks of windows: row, first window, windows, distance to the anchor, core hash, block hash.

    ``step`` is the width of the ranges of anchor distances into which windows are dealt.
    """
    reach = length - GRAM + 1
    lengths = np.diff(offsets)
    if len(body) < length or lengths.max(initial=0) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(body) > 1 << 27:
        raise ValueError("a text of over 2^27 bytes")
    core_hash, block_hash = PrefixHash(body, SEED_CORE), PrefixHash(body, SEED_BLOCK)
    low = np.uint64(27)
    grams = core_hash.every(GRAM)
    grams = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(grams, reach) & np.uint64((1 << 27) - 1)).astype(np.int64)
    rows = np.flatnonzero(lengths >= length)
    counts = lengths[rows] - length + 1
    place = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    row = np.repeat(rows, counts)
    anchor = anchor[place]
    part = (anchor - place) // step
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(part) != 0) | (np.diff(row) != 0)
    at = np.flatnonzero(new)
    until = np.concatenate((at[1:], [len(place)])) - 1
    first, last, anchor, part, row = place[at], place[until], anchor[at], part[at], row[at]
    widest = np.minimum((part + 1) * step, reach)
    core = core_hash.of(anchor - part * step, anchor - widest + 1 + length) ^ part.astype(np.uint64)
    block = block_hash.of(first, last + length)
    block = block ^ (((anchor - first) << 20) | (anchor - last)).astype(np.uint64)
    return row, first - offsets[row], last - first + 1, anchor - first, core, block


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, from running minima within blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Buckets:
    """Suffixes of some texts in buckets, and for each suffix a pointer to its bucket (the bucket's first place).

    ``lanes`` keep suffixes apart that nobody asks about: only those of one lane share a bucket.
    """

    def __init__(self, texts: list[bytes], lanes: np.ndarray) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # each text has an end, which is a place too
        self.starts = np.cumsum(sizes) - sizes
        self.body = np.frombuffer(b"\0".join(texts) + bytes(Q + 1), np.uint8)
        n = int(sizes.sum())
        self.end = np.repeat(self.starts + sizes - 1, sizes)
        real = np.flatnonzero(np.arange(n) < self.end)
        gram = np.zeros(len(real), np.int64)
        for k in range(Q):  # the end is the smallest symbol
            gram = gram * 257 + np.where(real + k < self.end[real], self.body[real + k].astype(np.int64) + 1, 0)
        key = lanes * np.int64(257**Q) + gram
        order = np.argsort(key, kind="stable")
        self.places, key = real[order], key[order]
        self.pointer = np.full(n, -1, np.int64)
        self.first_key = np.full(n, -1, np.int64)
        self.first_key[self.places] = key
        self._point(np.arange(len(key)), key)

    def _point(self, at: np.ndarray, key: np.ndarray) -> None:
        """The suffixes at ``at`` are sorted by ``key``: each run of it is a bucket."""
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.pointer[self.places[at]] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]

    def open(self) -> np.ndarray:
        """Places of the suffixes whose bucket has others, bucket by bucket."""
        bucket = self.pointer[self.places]
        same = bucket[1:] == bucket[:-1]
        shared = np.zeros(len(bucket), bool)
        shared[1:] |= same
        shared[:-1] |= same
        return np.flatnonzero(shared)

    def refine(self, depth: int) -> bool:
        """Buckets that stand for ``depth`` bytes are sorted by the buckets of the suffixes ``depth`` later.

        They are taken a share at a time, and each share finds the pointers as the shares before it left
        them, so that what one refinement found is used by the next.  False if nothing was left to do.
        """
        rest = self.open()
        if not len(rest):
            return False
        bucket = self.pointer[self.places[rest]]
        begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        cuts = np.unique(begins[np.searchsorted(begins, np.arange(SHARES) * len(rest) // SHARES, "right") - 1])
        for lo, hi in zip(cuts, np.append(cuts[1:], len(rest)), strict=True):
            at = rest[lo:hi]
            suffix = self.places[at]
            later = self.pointer[np.minimum(suffix + depth, self.end[suffix])]
            key = self.pointer[suffix] * np.int64(len(self.pointer) + 1) + later + 1
            order = np.argsort(key, kind="stable")
            self.places[at] = suffix[order]
            self._point(at, key[order])
        return True


def refine_buckets(texts: list[bytes], groups: np.ndarray, lefts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, which of its windows also occur in another text of its group.

    ``lefts`` are the distances of the first windows to the anchor: windows of a group can only be
    equal at equal distances, so group and distance are the lane.  Buckets of Q bytes are refined until
    they stand for ``length`` bytes or have one suffix.  Refinement may have told suffixes apart by what
    follows the window, so neighbours in the order that began in one bucket are compared byte by byte.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    column = np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes)[text_of] - lefts[text_of]
    _, lanes = np.unique(groups[text_of] * np.int64(1 << 32) + column, return_inverse=True)
    buckets, depth = Buckets(texts, lanes.astype(np.int64)), Q
    while depth < length and buckets.refine(depth):
        depth *= 2
    windows = buckets.places[buckets.end[buckets.places] - buckets.places >= length]
    before, after = windows[:-1], windows[1:]
    same = buckets.pointer[before] == buckets.pointer[after]
    ask = np.flatnonzero(~same & (buckets.first_key[before] == buckets.first_key[after]))
    body = np.lib.stride_tricks.sliding_window_view(buckets.body, length) if len(buckets.body) >= length else None
    for lo in range(0, len(ask), 4096):
        some = ask[lo : lo + 4096]
        same[some] = (body[before[some]] == body[after[some]]).all(axis=1)
    repeated = np.zeros(len(buckets.pointer), bool)
    repeated[before[same]] = repeated[after[same]] = True
    return [repeated[s : s + max(0, n - length + 1)] for s, n in zip(buckets.starts.tolist(), sizes.tolist(), strict=True)]


def bool_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of each run of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _blocks(length: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = arrow_bytes(batch.column("_text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("_k1", "_k2"))
            for lo, hi in portions(offsets, PORTION):
                at = offsets[lo : hi + 1]
                row, first, count, left, core, block = window_blocks(body[at[0] : at[-1]], at - at[0], length, step)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(k1[lo + row]), pa.array(k2[lo + row]), pa.array(first.astype(np.int32)),
                            pa.array(count.astype(np.int32)), pa.array(left.astype(np.int32)),
                            pa.array(core.view(np.int64)), pa.array(block.view(np.int64)),
                        ],
                        names=["_k1", "_k2", "first", "n_windows", "left", "core", "block"],
                    )

    return run


def _contexts(length: int):
    """Cuts the texts of the wanted blocks out of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["_text"].encode()
                out = {c: [] for c in ("core", "block", "copies", "_k1", "_k2", "first", "n_windows", "left", "body")}
                for x in row["wanted"]:
                    for c in ("core", "block", "copies", "first", "n_windows", "left"):
                        out[c].append(x[c])
                    out["_k1"].append(row["_k1"])
                    out["_k2"].append(row["_k2"])
                    out["body"].append(text[x["first"] : x["first"] + x["n_windows"] + length - 1])
                types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out)
                )

    return run


def _split(length: int, step: int):
    """Deals the windows of each block into finer blocks, whose cores are longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in batch.schema.names}
            for x in batch.to_pylist():
                body, left, count = x["body"], x["left"], x["n_windows"]
                for part in range(max(0, left - count + 1) // step, left // step + 1):
                    # the windows whose distance to the anchor is in [part * step, (part + 1) * step)
                    lo, hi = max(0, left - (part + 1) * step + 1), min(count - 1, left - part * step)
                    if lo > hi:
                        continue
                    core = body[left - part * step : left - (part + 1) * step + 1 + length]
                    inner = body[lo : hi + length]
                    values = x | {
                        "core": _digest(core, x["core"], part), "block": _digest(inner, left - lo, left - hi),
                        "first": x["first"] + lo, "n_windows": hi - lo + 1, "left": left - lo, "body": inner,
                    }
                    for c in out:
                        out[c].append(values[c])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in batch.schema], schema=batch.schema)

    return run


def _digest(data: bytes, *more: int) -> int:
    h = hashlib.blake2b(data, digest_size=8, key=repr(more).encode()[:64])
    return int.from_bytes(h.digest(), "little", signed=True)


def _refined(length: int, most: int):
    """Runs of windows that repeat, for blocks with one copy; rows come sorted by core."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        _, groups = np.unique(np.array([x["core"] for x in rows], np.int64), return_inverse=True)
        lefts = np.array([x["left"] for x in rows], np.int64)
        out = ([], [], [], [])
        for x, flags in zip(rows, refine_buckets([x["body"] for x in rows], groups, lefts, length), strict=True):
            if x["copies"] == 1:
                for lo, hi in zip(*bool_runs(flags), strict=True):
                    for column, value in zip(out, (x["_k1"], x["_k2"], x["first"] + lo, x["first"] + hi - 1), strict=True):
                        column.append(int(value))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["_k1", "_k2", "lo", "hi"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                if size > most and held[-1]["core"] != x["core"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(x)
                size += len(x["body"])
        if held:
            yield solve(held)

    return run


def repeated_windows(docs: DataFrame, length: int = 400, bucket_limit: int = 4096, paths: list[str] | None = None) -> DataFrame:
    """Runs of windows that start elsewhere too, as rows (_k1, _k2, lo, hi) of first and last window.

    ``docs`` has _k1, _k2 and _text.  The paths of the tables that the result reads are added to ``paths``.
    """
    keep_as = partial(materialize, paths=paths)
    step = (length - GRAM + 2) // 2
    blocks = keep_as(docs.mapInArrow(tidy(_blocks(length, step)), BLOCK_SCHEMA), "blocks")
    cores = (
        blocks.groupBy("core")
        .agg(F.count("*").alias("n"), F.min("block").alias("least"), F.max("block").alias("most"))
        .where("n > 1")
        .select("core", (F.col("least") != F.col("most")).alias("mixed"))
    )
    # written first, so that both sides of the join are plain exchanges and a hot core can be split
    found = keep_as(blocks.join(keep_as(cores, "cores"), "core"), "shared")
    last = (F.col("first") + F.col("n_windows") - 1).alias("hi")
    run_of = lambda df: df.select("_k1", "_k2", F.col("first").alias("lo"), last)
    one = F.struct("_k1", "_k2", "first", "n_windows", "left")
    kinds = found.groupBy("core", "block").agg(F.count("*").alias("copies"), F.min(one).alias("one"), F.first("mixed").alias("mixed"))
    kinds = keep_as(kinds, "kinds")
    runs = [run_of(found.join(kinds.where("copies > 1").select("core", "block"), ["core", "block"], "left_semi"))]
    wanted = (
        kinds.where("mixed")
        .select("core", "block", "copies", "one.*")
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("core", "block", "copies", "first", "n_windows", "left")).alias("wanted"))
    )
    contexts = (
        docs.join(wanted, ["_k1", "_k2"]).select("_k1", "_k2", "_text", "wanted").mapInArrow(tidy(_contexts(length)), CONTEXT_SCHEMA)
    )
    contexts = keep_as(contexts, "contexts").dropDuplicates(["core", "block"])
    hot = lambda df: df.groupBy("core").count().where(F.col("count") > bucket_limit).select("core")
    while True:
        crowded = keep_as(hot(contexts), "hot")
        runs.append(_refine(contexts.join(crowded, "core", "left_anti"), length))
        if crowded.isEmpty():
            break
        step = max(1, -(-step // 8))
        finer = keep_as(
            contexts.join(crowded, "core", "left_semi").mapInArrow(tidy(_split(length, step)), CONTEXT_SCHEMA), "finer"
        )
        # equal finer blocks of different blocks repeat each other; only one of them is needed on
        per_block = finer.groupBy("core", "block").agg(F.count("*").alias("blocks"), F.max("copies").alias("_copies"))
        per_block = keep_as(per_block, "finer-blocks")
        many = per_block.where("blocks > 1").select("core", "block")
        runs.append(run_of(finer.where("copies = 1").join(many, ["core", "block"], "left_semi")))
        if step == 1:
            break
        groups = per_block.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
        keep = finer.join(groups, "core", "left_semi").dropDuplicates(["core", "block"]).drop("copies")
        contexts = keep_as(
            keep.join(
                per_block.select("core", "block", F.when(F.col("blocks") > 1, F.lit(2).cast("long")).otherwise(F.col("_copies")).alias("copies")),
                ["core", "block"],
            ).select("core", "block", "copies", "_k1", "_k2", "first", "n_windows", "left", "body"),
            "contexts",
        )
    total = runs[0]
    for more in runs[1:]:
        total = total.unionByName(more)
    return total


def _refine(contexts: DataFrame, length: int) -> DataFrame:
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "core").sortWithinPartitions("core").mapInArrow(tidy(_refined(length, 1 << 21)), RUN_SCHEMA)


def words_in(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words, whole or cut at an edge, each byte range has."""
    inside = SPACED_WORD[text]
    starts = np.concatenate(([0], np.cumsum(inside & ~np.concatenate(([False], inside[:-1])))))
    return starts[end] - starts[begin + 1] + inside[begin]


def covered(size: int, runs: pa.StructArray | None, length: int) -> np.ndarray:
    """The bytes of a text of ``size`` bytes that lie in a window of these runs."""
    edge = np.zeros(size + 1, np.int64)
    if runs is not None and len(runs):
        lo, hi = (runs.field(c).to_numpy() for c in ("lo", "hi"))
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _applied(
    batches: Iterator[pa.RecordBatch], length: int, least_words: int, passages: tuple[int, int] | None, out: pa.Schema
) -> Iterator[pa.RecordBatch]:
    extra = [f.name for f in out if f.name not in MADE]
    for batch in batches:
        body, offsets = arrow_bytes(batch.column("_text"))
        runs = batch.column("_runs")
        values = {c: [] for c in MADE}
        for k in range(batch.num_rows):
            text = body[offsets[k] : offsets[k + 1]]
            gone = covered(len(text), runs[k].values, length)
            begin, end = bool_runs(gone)
            if least_words and len(begin):
                enough = words_in(text, begin, end) >= least_words
                for a, b in zip(begin[~enough].tolist(), end[~enough].tolist(), strict=True):
                    gone[a:b] = False
                begin, end = begin[enough], end[enough]
            kept = text[~gone].tobytes() if len(begin) else text.tobytes()
            values["n_bytes"].append(len(text))
            values["n_removed"].append(len(text) - len(kept))
            values["n_spans"].append(len(begin))
            values["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            values["kept"].append(kept.decode("utf-8", "ignore") if len(begin) else kept.decode())
            values["spans"].append([{"lo": int(a), "hi": int(b)} for a, b in zip(begin, end, strict=True)])
            if passages:
                begin, end = bool_runs(covered(len(text), batch.column("_shorter")[k].values, passages[0]))
                enough = words_in(text, begin, end) >= passages[1] if len(begin) else np.zeros(0, bool)
                values["n_passages"].append(int(enough.sum()))
                values["passage_bytes"].append(int((end - begin)[enough].sum()))
        columns = [batch.column(c) if c in extra else pa.array(values[c], out.field(c).type) for c in out.names]
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_type(c.type) for f, c in zip(out, columns, strict=True)]))


def remove_repeated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, least_words: int = 0, bucket_limit: int = 4096,
    keep: tuple[str, ...] = (), passages: tuple[int, int] | None = None,
) -> DataFrame:
    """Remove the bytes that any repeated string of ``length`` bytes covers.

    With ``least_words`` a stretch of such bytes that has fewer words (whole or cut at its edge) stays.

    Returns one row per input row: the id, the columns named in ``keep``, n_bytes, n_removed,
    n_spans, kept_sha256, kept (the remaining text; characters cut at a span's edge go) and spans
    (byte ranges).  Null texts count as empty, texts below ``length`` bytes are never changed, rows
    that repeat another repeat all its strings, an empty table gives an empty table; other columns
    play no part, whatever their names.  A kept column that is named like one made here gets ``_in`` behind its name.

    ``passages`` (bytes below ``length``, words) adds n_passages and passage_bytes: how many stretches of bytes
    that repeated strings of so many bytes cover have so many words (whole or cut at an edge), and their bytes.
    They are told of the input and change nothing that is removed.
    """
    if passages and passages[0] >= length:
        raise ValueError("passages are looked for by strings shorter than those removed")
    bound_batches(df.sparkSession)
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate((id_col, *keep))]
    docs = df.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("_text"), *carried)
    key, keyed, run = ["_k1", "_k2"], docs.select("_k1", "_k2", "_text"), F.struct("lo", "hi")
    if passages:
        paths: list[str] = []
        shorter = materialize(repeated_windows(keyed, passages[0], bucket_limit, paths), "shorter")
        discard(df.sparkSession, paths)
        # a window that repeats holds so many shorter ones, and all of them repeat: other rows have none
        holds = shorter.groupBy(key).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).where(F.col("n") > length - passages[0])
        keyed = materialize(keyed.join(holds, key, "left_semi"), "holds")
    runs = repeated_windows(keyed, length, bucket_limit)
    if passages:
        runs = runs.withColumn("short", F.lit(False)).unionByName(shorter.withColumn("short", F.lit(True)))
        lists = [F.collect_list(F.when(~F.col("short"), run)).alias("_runs"), F.collect_list(F.when(F.col("short"), run)).alias("_shorter")]
    else:
        lists = [F.collect_list(run).alias("_runs")]
    per_row = runs.groupBy(key).agg(*lists)
    types = dict(docs.dtypes)
    names = [f"_c{i}" for i in range(len(carried))]
    schema = ", ".join(f"`{c}` {types[c]}" for c in names)
    schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<lo:long,hi:long>>"
    schema += ", n_passages long, passage_bytes long" if passages else ""
    out = to_arrow_schema(_parse_datatype_string(schema))
    done = docs.join(per_row, key, "left").mapInArrow(tidy(lambda it: _applied(it, length, least_words, passages, out)), schema)
    return done.withColumnsRenamed(dict(zip(names, (id_col, *(carried_name(c, MADE) for c in keep)), strict=True)))

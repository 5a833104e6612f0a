"""Sequence packing: Martello-Toth dominance reduction, then best fit of what remains.

Lengths are whole numbers up to the capacity, so the instance is its histogram of lengths.  All
decisions are made on that histogram, which has ``capacity`` entries at any corpus size: patterns
(multisets of lengths that share a sequence) are fixed many times over at once.  The reduction walks
the lengths from the longest down and fixes the sets that provably dominate every other set with
that length in it; best-fit decreasing packs the rest.  The plan is a list of ranges: "the k-th to
the n-th document of length a go to sequences from s on, at offset o".  Documents are numbered within
their length by counts per (length, bucket), so no length is gathered in one place, and look their
range up in the plan.
"""

from __future__ import annotations

import functools
import os
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, materialize, tidy, text_or_empty

#: Pieces whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Marks that may end a stretch of letters.
MARKS = string.punctuation
ROWS_A_BUCKET = 100_000
#: The last Latin letter of those that every version of the character tables knows.
LAST_LATIN = "\u024f"
#: The letter by which a byte-level vocabulary writes each byte: its own if it is visible, else the next free one from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}


class Plan:
    """Ranges of documents of one length and where they go; ``sequences`` counts the sequences."""

    def __init__(self) -> None:
        self.sequences = 0
        self.used: dict[int, int] = {}
        self.ranges: list[tuple[int, int, int, int, int]] = []  # length, first rank, in a row, sequence, offset

    def place(self, pattern: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences that each hold ``n`` documents of each length of the pattern."""
        offset = 0
        for length, n in pattern:
            self.ranges.append((length, self.used.get(length, 0), n, self.sequences, offset))
            self.used[length] = self.used.get(length, 0) + n * times
            offset += n * length
        self.sequences += times


def dominant(counts: np.ndarray, a: int, capacity: int) -> tuple[tuple[int, ...], int] | None:
    """A set with length ``a`` that dominates all others in the instance, and how often it can be fixed.

    A set dominates another if the other's lengths can be dealt to its own so that none gets more
    than its own length: exchanging the sets then never costs a sequence.
    """
    left = counts.copy()
    left[a] -= 1
    room = capacity - a
    fits = np.flatnonzero(left[: room + 1])
    if not len(fits):
        return (a,), int(counts[a])
    k = int(fits[-1])
    times = int(counts[a] // 2 if k == a else min(counts[a], counts[k]))
    smallest: list[int] = []
    for length in fits[:3]:
        smallest += [int(length)] * int(min(3 - len(smallest), left[length]))
    if k == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (a, k), times  # the gap is closed, or nothing else goes beside one more length
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # two more lengths at most: find the pair x >= y that fills the gap best and the largest y of any pair
    best, widest = 0, 0
    for y in fits:
        partners = fits[(fits >= y) & (fits <= room - y)]
        if len(partners) and partners[0] == y and left[y] < 2:
            partners = partners[1:]
        if len(partners):
            best, widest = max(best, int(partners[-1] + y)), int(y)
    if best <= k:
        return (a, k), times
    left[k] -= 1
    second = np.flatnonzero(left[: room - k + 1])
    if len(second) and int(second[-1]) >= widest:
        s = int(second[-1])
        need = np.bincount([a, k, s])
        have = np.flatnonzero(need)
        return (a, k, s), int((counts[have] // need[have]).min())
    return None


def pack_histogram(counts: np.ndarray, capacity: int) -> Plan:
    """A plan for ``counts[length]`` documents of each length from 1 to ``capacity``."""
    counts, plan = np.array(counts, np.int64), Plan()
    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(counts)[::-1]:
            while counts[a] and (found := dominant(counts, int(a), capacity)):
                lengths, times = found
                if not times:
                    break
                plan.place([(x, lengths.count(x)) for x in dict.fromkeys(lengths)], times)
                for x in lengths:
                    counts[x] -= times
                changed = True
    # best fit, the longest first; open sequences with one content are kept as (content, how many)
    open_by_room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for a in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[a])
        placed: list[tuple[int, list[tuple[int, int]], int]] = []
        for room in sorted(r for r in open_by_room if r >= a):
            each = room // a
            groups = open_by_room.pop(room)
            while groups and todo:
                content, times = groups.pop()
                full = min(times, todo // each)
                if full:
                    placed.append((room - each * a, [*content, (a, each)], full))
                    todo -= full * each
                if full < times and todo:
                    placed.append((room - todo * a, [*content, (a, todo)], 1))
                    full, todo = full + 1, 0
                if full < times:
                    groups.append((content, times - full))
            if groups:
                open_by_room[room] = groups
            if not todo:
                break
        each = capacity // a
        if todo // each:
            placed.append((capacity - each * a, [(a, each)], todo // each))
        if todo % each:
            placed.append((capacity - todo % each * a, [(a, todo % each)], 1))
        for room, content, times in placed:
            open_by_room.setdefault(room, []).append((content, times))
    for room in sorted(open_by_room):
        for content, times in open_by_room[room]:
            plan.place(content, times)
    return plan


class Remembered(dict):
    """Ids of text pieces; of two generations the older is dropped when the younger is full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Token ids of texts, with the ids of recurring pieces remembered.

    The byte-level pattern of the vocabulary always cuts before a space that a visible character
    follows, between a letter and the marks at the end of such a stretch, and around a line end that
    stands between visible characters; so these pieces can be encoded alone.  A text with one of the vocabulary's added tokens goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = added
        self.model = self.tokenizer.model
        self.known = Remembered(self.piece)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """Of one piece; a word of Latin letters is never cut, so the vocabulary's merges are asked at once."""
        word = text[1:] if text[0] == " " else text
        if not word.isalpha() or not (word.isascii() or max(word) <= LAST_LATIN):
            return self.whole(text)
        letters = text.replace(" ", BYTE_LETTERS[32]) if word.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def pieces(self, text: str) -> list[str]:
        first, *parts = text.split(" ")
        out, newlines = [first] if first else [], "\n" in text
        for p in parts:
            if not p or p[0].isspace():
                out.append(out.pop() + " " + p if out else " " + p)
                continue
            p = " " + p
            if newlines and "\n" in p:
                lines = p.split("\n")
                if not any(not q or q[-1].isspace() or (k and q[0].isspace()) for k, q in enumerate(lines)):
                    for q in lines[:-1]:
                        out += (q, "\n")
                    p = lines[-1]
            head = p.rstrip(MARKS)
            if len(head) < len(p) and head and head[-1].isalpha():
                out.append(head)
                p = p[len(head) :]
            out.append(p)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if any(a in text for a in self.added):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, self.pieces(text)))


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that what one task remembers serves the next."""
    return Encoder(path)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("_id"), batch.column("_text").to_pylist()
            for lo in range(0, len(texts), 64):
                out = {c: [] for c in ("at", "piece", "start", "length", "ids_crc32")}
                for k, text in enumerate(texts[lo : lo + 64], lo):
                    data = encoder.encode(text) + end
                    n = len(data) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for c, v in zip(out, (k, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b])), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(out["at"], pa.int64())), pa.array(out["piece"], pa.int32())]
                    + [pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")],
                    names=["_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _looked_up(ranges: np.ndarray):
    """Adds sequence and offset by binary search for (length, rank) in the plan's ranges."""
    keys = (ranges[:, 0] << np.int64(48)) | ranges[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            r = ranges[np.searchsorted(keys, (length << np.int64(48)) | rank, "right") - 1]
            nth = rank - r[:, 1]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(r[:, 3] + nth // r[:, 2]), pa.array(r[:, 4] + nth % r[:, 2] * length)],
                names=[*kept, "sequence_id", "offset"],
            )

    return run


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``."""
    spark: SparkSession = pieces.sparkSession
    n = pieces.count()
    buckets = max(1, -(-n // ROWS_A_BUCKET))
    order = [c for c in pieces.columns if c != "length"]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = materialize(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r.length] = r.n
    plan = pack_histogram(counts, capacity)
    ranges = np.array(sorted(plan.ranges) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_row", F.row_number().over(within)).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    types = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in pieces.columns) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(_looked_up(ranges)), schema)


def pack_documents(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut into full pieces behind
    a first piece that may be shorter.  Null texts count as empty (one token), repeated rows are
    packed each, null ids stay null, an empty table gives an empty table; other columns are ignored.
    """
    bound_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = dict(source.dtypes)["_id"]
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(source.mapInArrow(tidy(_pieces(tokenizer_path, end_id, capacity)), schema), "pieces")
    return pack_pieces(pieces, capacity).withColumnRenamed("_id", id_col)

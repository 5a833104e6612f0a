"""SimHash near-duplicates: segment popcounts, a grid range-join, exact verification.

The fingerprint's bits are cut into segments; the vector of their popcounts is the embedding.  The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints.  The
grid: the segments form ``groups``; if two fingerprints differ in ``radius`` bits at most, all but
``radius`` groups have equal popcounts, so the pair shares a grid cell of the sub-space of some
``groups - radius`` groups.  Within a cell pairs are kept by Manhattan distance, then by exact
distance.  A cell with more than ``cell_limit`` fingerprints is not compared: its members go to a
finer grid (single-bit segments, more groups).  In the finest grid a cell fixes 52 of 64 bits, so it
holds 4,096 fingerprints at most whatever the data.  Within cells only links are made that the
groups need to hang together, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, PrefixHash, arrow_bytes, bound_batches, lowered, materialize, mix, portions, tidy, text_or_empty, word_spans

#: (bits a segment, groups of segments) of each grid, from coarse to fine.
GRIDS = ((2, 6), (1, 8), (1, 16))
PAIRS_OF_BITS = 0x5555555555555555


def shingle_hashes(body: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the rows' ``words``-word shingles (fewer words: of the whole sequence), and their number by row."""
    body = lowered(body)
    start, end, row = word_spans(body, offsets, SPACED_WORD)
    n_rows = len(offsets) - 1
    counts = np.bincount(row, minlength=n_rows)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    # single spaces between words, so that a shingle is one slice
    sizes = end - start
    at = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    flat = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    flat[np.repeat(at - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())] = body[
        np.repeat(start - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    ]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    total = int(shingles.sum())
    begin = np.repeat(first - np.concatenate(([0], np.cumsum(shingles)[:-1])), shingles) + np.arange(total)
    owner = np.repeat(np.arange(n_rows), shingles)
    last = begin + np.minimum(words, counts[owner]) - 1
    lo, hi = at[begin], at[last] + sizes[last]
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], 42) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, total), shingles


def fingerprints(hashes: np.ndarray, shingles: np.ndarray, width: int = 1) -> np.ndarray:
    """SimHashes of 64 x ``width`` bits of the rows' shingles, as rows of 64-bit numbers.

    The first number comes from the shingles' XXH64 itself, the others from mixtures of it.
    """
    out = np.zeros((len(shingles), width), np.uint64)
    have = np.flatnonzero(shingles)
    if not len(have):
        return out
    cut = np.concatenate(([0], np.cumsum(shingles[have])))
    for k in range(width):
        mixed = mix(hashes + np.uint64(k)) if k else hashes
        for a in range(0, len(have), 256):
            b = min(a + 256, len(have))
            part = np.unpackbits(mixed[cut[a] : cut[b]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            at = (cut[a : b + 1] - cut[a]).tolist()
            bits = np.array([part[lo:hi].sum(axis=0, dtype=np.int32) for lo, hi in zip(at[:-1], at[1:], strict=True)])
            over = np.packbits(2 * bits > shingles[have[a:b]][:, None], axis=1)
            out[have[a:b], k] = over.view(">u8").ravel()
    return out


def _hashed(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingle hashes and their number by row, for portions of the rows."""
    body, offsets = arrow_bytes(column)
    for lo, hi in portions(offsets, 1 << 21):
        yield shingle_hashes(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)


def _fingerprinted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.zeros((0, 1), np.uint64)] + [fingerprints(*x) for x in _hashed(batch.column("_text"), words)]
            last = pa.array(np.concatenate(got).ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), last], names=["_id", "_fp"])

    return run


def grid_masks(width: int, groups: int, radius: int) -> list[int]:
    """Bit masks of the sub-spaces: all choices of ``groups - radius`` groups of segments."""
    segments = np.array_split(np.arange(64 // width), groups)
    masks = [sum(((1 << width) - 1) << int(s * width) for s in group) for group in segments]
    chosen = (sum(x) for x in itertools.combinations(masks, groups - radius))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _cells(prints: DataFrame, width: int, groups: int, radius: int) -> DataFrame:
    """(mask number, popcount vector in that sub-space, fingerprint)."""
    vector = F.col("fp")
    if width == 2:  # the popcounts of two-bit segments, side by side in two bits each
        low, high = vector.bitwiseAND(PAIRS_OF_BITS), F.shiftrightunsigned(vector, 1).bitwiseAND(PAIRS_OF_BITS)
        vector = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    cells = [
        F.struct(F.lit(i).alias("grid"), vector.bitwiseAND(F.lit(m)).alias("cell"))
        for i, m in enumerate(grid_masks(width, groups, radius))
    ]
    return prints.select("fp", F.explode(F.array(*cells)).alias("at")).select("at.grid", "at.cell", "fp")


def popcounts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of eight segments of each fingerprint (rows of 64-bit numbers)."""
    n, width = prints.shape
    counts = np.bitwise_count(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8, width))
    return counts.sum(axis=2).astype(np.int16)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def links_within(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs at ``radius`` bits at most which tie together all that such pairs connect."""
    n, vectors = len(prints), popcounts(prints)
    label = np.arange(n)
    links = []
    for lo in range(0, n, 256):
        rows = slice(lo, min(lo + 256, n))
        manhattan = np.zeros((rows.stop - lo, n), np.int16)
        for k in range(vectors.shape[1]):
            manhattan += np.abs(vectors[rows, k][:, None] - vectors[None, :, k])
        a, b = np.nonzero(manhattan <= radius)
        a, keep = a + lo, b > a + lo
        a, b = a[keep], b[keep]
        near = differing(prints[a], prints[b]) <= radius
        a, b = a[near], b[near]
        cut = np.searchsorted(a, np.arange(rows.start, rows.stop + 1))
        for i in range(rows.start, rows.stop):
            others = b[cut[i - lo] : cut[i - lo + 1]]
            kinds, first = np.unique(label[others], return_index=True)
            for kind, at in zip(kinds.tolist(), first.tolist(), strict=True):
                if kind != label[i]:
                    links.append((i, int(others[at])))
                    label[label == kind] = label[i]
    return links


def _verified(radius: int, width: int, row: int = 1):
    """Links within cells; small cells of one size are compared together.

    A member is ``row`` numbers: the ``width`` of its fingerprint, and the last is what links name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prints")
            values = lists.flatten().to_numpy().view(np.uint64).reshape(-1, row)
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy() // row)))
            sizes = np.diff(at)
            none = np.zeros(0, np.uint64)
            left, right = [none], [none]
            for size in np.unique(sizes):
                cells = np.flatnonzero(sizes == size)
                if size <= 8:
                    table = values[at[cells][:, None] + np.arange(size)[None, :]]
                    vectors = popcounts(table[..., :width].reshape(-1, width)).reshape(len(cells), size, -1)
                    for i, j in itertools.combinations(range(size), 2):
                        near = np.abs(vectors[:, i] - vectors[:, j]).sum(axis=1) <= radius
                        near[near] = differing(table[near, i, :width], table[near, j, :width]) <= radius
                        left.append(table[near, i, -1])
                        right.append(table[near, j, -1])
                else:
                    for c in cells:
                        cell = values[at[c] : at[c + 1]]
                        pairs = np.array(links_within(cell[:, :width], radius), np.int64).reshape(-1, 2)
                        left.append(cell[pairs[:, 0], -1])
                        right.append(cell[pairs[:, 1], -1])
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = 3, cell_limit: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose closure is that of all close pairs."""
    links = None
    for level, (width, groups) in enumerate(GRIDS):
        finest = level == len(GRIDS) - 1
        cells = _cells(prints, width, groups, radius)
        counted = materialize(cells.groupBy("grid", "cell").count().where("count > 1"), "cells")
        small = counted if finest else counted.where(F.col("count") <= cell_limit)
        lists = cells.join(small.drop("count"), ["grid", "cell"]).groupBy("grid", "cell")
        found = lists.agg(F.collect_list("fp").alias("prints")).select("prints").mapInArrow(tidy(_verified(radius, 1)), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if finest:
            break
        crowded = counted.where(F.col("count") > cell_limit).drop("count")
        if crowded.isEmpty():
            break
        prints = materialize(cells.join(crowded, ["grid", "cell"], "left_semi").select("fp").distinct(), "crowded")
    return materialize(links.distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps; each step's links are written out.
    """
    edges, sums = links.select("a", "b"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        large = materialize(large.distinct(), "large-star")
        down = large.select(F.col("b").alias("node"), F.col("a").alias("below"))
        least = down.groupBy("node").agg(F.min("below").alias("m"))
        small = down.join(least, "node").select(F.col("m").alias("a"), F.col("below").alias("b")).where("a < b")
        small = small.unionByName(least.select(F.col("m").alias("a"), F.col("node").alias("b"))).distinct()
        edges = materialize(small, "small-star")
        # two sums of hashes tell whether the edges are those of the step before: then nothing moved
        before, sums = sums, edges.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(k), "a", "b").cast("decimal(20)")) for k in (1, 2))).first()
        if sums == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


#: 64-bit parts of a wide fingerprint.
WIDE, SEED_WORD = 4, 51
PRINTS = tuple(f"f{k}" for k in range(WIDE))
STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def sequence_hashes(body: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the rows' ``words``-word shingles (fewer words: of the whole sequence), and their number by row."""
    body = lowered(body)
    start, end, row = word_spans(body, offsets, SPACED_WORD)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    if not len(start):
        return np.zeros(0, np.uint64), shingles
    word = np.append(PrefixHash(body, SEED_WORD).of(start, end), np.zeros(words, np.uint64))
    first = np.cumsum(counts) - counts
    begin = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    size = np.minimum(words, counts)[np.repeat(np.arange(len(counts)), shingles)]
    total = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(words):
        total += np.where(k < size, word[begin + k], 0) * STEPS[k % len(STEPS)] ** np.uint64(k // len(STEPS) + 1)
    return mix(total), shingles


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each row's sorted set of shingle hashes."""
    body, offsets = arrow_bytes(column)
    for lo, hi in portions(offsets, 1 << 21):
        hashes, shingles = sequence_hashes(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
        cut = np.concatenate(([0], np.cumsum(shingles))).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield np.unique(hashes[a:b])


def digest_of(found: np.ndarray) -> bytes:
    """The 128-bit node of a shingle set; its first half is the node's number in the search for candidates."""
    return xxhash.xxh3_128_digest(found.tobytes())


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHashes of 64 x WIDE bits; a repeated passage does not move them, since sets have no repeats."""
    sizes = np.array([len(x) for x in sets], np.int64)
    return fingerprints(np.concatenate([np.zeros(0, np.uint64), *sets]), sizes, WIDE)


def _nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                sets = list(shingle_sets(some.column("_text"), words))
                nodes, prints = [digest_of(x) for x in sets], wide_prints(sets).view(np.int64)
                number = np.frombuffer(b"".join(nodes), "<i8")[::2]
                columns = [some.column("_id"), some.column("_key"), pa.array(nodes, pa.binary()), pa.array(number)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WIDE))], names=["_id", "_key", "_fp", "number", *PRINTS]
                )

    return run


def prefix_length(size: int, similarity: float) -> int:
    """Two sets of at least this Jaccard similarity share one of so many least elements of each."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _prefixes(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                sets = list(shingle_sets(batch.column("_text").slice(lo, 1024), words))
                number = np.array([int.from_bytes(digest_of(x)[:8], "little", signed=True) for x in sets], np.int64)
                least = [x[: prefix_length(len(x), similarity)] for x in sets]
                at = np.cumsum([0, *(len(x) for x in least)])
                cells = pa.array(np.concatenate(least).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.ListArray.from_arrays(pa.array(at, pa.int32()), cells)], names=["number", "cells"])

    return run


def block_pairs(members: DataFrame, key: str, by: str, blocks, *columns: str) -> DataFrame:
    """(key, i, j, block, columns): each of a key's ``blocks`` blocks, dealt by ``by``, together with each other one.

    All members of a key meet, but no group (key, i, j) has more than two blocks of them.
    """
    dealt = members.select(key, *columns, blocks.alias("_n"), F.pmod(F.xxhash64(by), blocks).alias("block"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_o")).where("_n = 1 or block != _o")
    return dealt.select(key, F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", *columns)


def within_radius(left: str, right: str, radius: int):
    """The popcounts of 16-bit segments first (their Manhattan distance is a lower bound), then the exact distance."""
    manhattan, exact = F.lit(0), F.lit(0)
    for f in PRINTS:
        a, b = F.col(f"{left}.{f}"), F.col(f"{right}.{f}")
        for shift in range(0, 64, 16):
            count = lambda x, shift=shift: F.bit_count(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFF).cast("long")))
            manhattan = manhattan + F.abs(count(a) - count(b))
        exact = exact + F.bit_count(a.bitwiseXOR(b))
    return (manhattan <= radius) & (exact <= radius)


def wide_links(source: DataFrame, nodes: DataFrame, words: int, similarity: float, radius: int, cell_limit: int = 2048) -> DataFrame:
    """Links (a, b) between distinct node numbers with a cell in common and ``radius`` bits apart at most.

    A cell is a shingle of the prefix, so no pair of the wanted similarity is without one.  Copies in a
    cell are combined before anything is shuffled.  Cells of two nodes are pairs at once.  Of the others
    the members are fetched; a cell of more than ``cell_limit`` is cut into blocks and every pair of its
    blocks is compared.
    """
    prefixes = source.select("_text").mapInArrow(tidy(_prefixes(words, similarity)), "number long, cells array<long>")
    cells = prefixes.select(F.explode("cells").alias("cell"), "number")
    shared = cells.groupBy("cell").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n"))
    shared = materialize(shared.where("lo != hi"), "shared")
    prints = nodes.select("number", F.struct(*PRINTS).alias("p"))
    pairs = shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(prints.select(F.col("number").alias(end), F.col("p").alias(f"p{end}")), end)
    found = pairs.where(within_radius("pa", "pb", radius)).select("a", "b")
    many = cells.join(shared.where("n > 2").select("cell"), "cell").distinct()
    many = materialize(many.join(prints, "number").select("cell", "number", "p.*"), "members")
    crowded = materialize(many.groupBy("cell").count().where(F.col("count") > cell_limit), "crowded")
    blocks = F.coalesce(F.ceil(F.col("count") / cell_limit), F.lit(1))
    lists = block_pairs(many.join(crowded, "cell", "left"), "cell", "number", blocks, "number", *PRINTS).groupBy("cell", "i", "j")
    lists = lists.agg(F.collect_list(F.array(*PRINTS, "number")).alias("prints")).where(F.size("prints") > 1)
    lists = lists.select(F.flatten("prints").alias("prints"))
    found = found.unionByName(lists.mapInArrow(tidy(_verified(radius, WIDE, WIDE + 1)), "a long, b long"))
    return materialize(found.where("a != b").distinct(), "links")


def wide_radius(similarity: float) -> int:
    """Bits of a wide fingerprint in which shingle sets of this Jaccard similarity differ on average."""
    return round(64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def similar_between(sets: list[np.ndarray], names: list[bytes], some: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Index pairs, one of each among ``some``, of sorted sets whose Jaccard similarity is ``similarity`` or more.

    Of all such pairs those are given which tie together what the pairs connect; equal ``names`` are one set.
    """
    sizes = np.array([len(x) for x in sets])
    n, flat, owner = len(sets), np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # what one set alone has is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, step = int(shared.sum()), max(256, (1 << 22) // n)
    common = np.zeros((len(some), n), np.float32)
    for lo in range(0, total, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        part = np.zeros((n, min(step, total - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        common += part[some] @ part.T
    near = common >= similarity * (sizes[some][:, None] + sizes[None, :] - common) - 1e-6
    _, label = np.unique(np.array(names, object), return_inverse=True)
    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        i = int(some[i])
        if label[i] != label[j]:
            links.append((i, j))
            label[label == label[j]] = label[i]
    return links


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                sets = list(shingle_sets(batch.column("_text").slice(lo, 1024), words))
                nodes = [digest_of(x) for x in sets]
                number = [int.from_bytes(x[:8], "little", signed=True) for x in nodes]
                flat = pa.array(np.concatenate(sets).view(np.int64))
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(nodes, pa.binary()), held], names=["number", "node", "set"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column("members")[k].values
                names, values = members.field("node").to_pylist(), members.field("set")
                sets = [values[i].values.to_numpy().view(np.uint64) for i in range(len(values))]
                some = np.flatnonzero(members.field("open").to_numpy(zero_copy_only=False))
                pairs = [sorted((names[i], names[j])) for i, j in similar_between(sets, names, some, similarity)]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return run


def similar_links(
    groups: DataFrame, candidates: DataFrame, texts: DataFrame, words: int, similarity: float, most: int = 1024, most_bytes: int = 4 << 20
) -> DataFrame:
    """Links (a, b) between nodes of one group (number, root) that are similar by their whole shingle sets.

    ``texts`` (_text) has a text of each node, ``candidates`` are the links (a, b) that made the groups.
    First all are compared with the member that has most of these, then those that it does not link with
    all members.  That goes by blocks of ``most`` members or ``most_bytes`` against blocks of these sizes,
    so that no task's work grows with a group; whatever is connected by similar pairs is by these links.
    """
    sets = materialize(texts.mapInArrow(tidy(_sets(words)), "number long, node binary, set array<long>").dropDuplicates(["node"]), "sets")
    members = materialize(groups.join(sets, "number"), "members")
    degree = candidates.select(F.explode(F.array("a", "b")).alias("number")).groupBy("number").agg(F.count("*").alias("d"))
    middle = groups.join(degree, "number").groupBy("root").agg(F.max_by("number", F.struct("d", "number")).alias("number"))
    middle = members.join(middle, ["root", "number"]).groupBy("root").agg(F.min_by(F.struct("node", "set"), "node").alias("m"))
    common = F.size(F.array_intersect("set", "m.set"))
    near = common >= similarity * (F.size("set") + F.size("m.set") - common) - 1e-6
    judged = members.join(middle, "root").where(F.col("node") != F.col("m.node")).select("root", "node", F.col("m.node").alias("middle"), near.alias("near"))
    judged = materialize(judged, "judged")
    found = judged.where("near").select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b"))
    rest = members.join(judged.where("not near").select("node"), "node")
    parts = lambda df, name: df.groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / most, F.sum(F.size("set")) * 8 / most_bytes)).cast("long").alias(name)
    )
    sizes = materialize(parts(rest, "_i").join(parts(members, "_j"), "root"), "open")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rest.join(sizes, "root").select("root", "node", "set", F.lit(True).alias("open"), block("_i").alias("i"), each("_j").alias("j"))
    right = members.join(sizes, "root").select("root", "node", "set", F.lit(False).alias("open"), each("_i").alias("i"), block("_j").alias("j"))
    lists = left.unionByName(right).groupBy("root", "i", "j").agg(F.collect_list(F.struct("node", "set", "open")).alias("members"))
    found = found.unionByName(lists.select("members").mapInArrow(tidy(_similar(similarity)), "a binary, b binary"))
    return materialize(found.distinct(), "similar")


def link_similar(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, cell_limit: int = 2048
) -> DataFrame:
    """Like ``link_near_duplicates``, for Jaccard similarity of shingle sets in place of a few differing bits.

    Candidates share a cell and their 256-bit fingerprints differ by the similarity's mean and six
    deviations at most (sets of few shingles stray further than the law has it).  Within what candidates
    connect, whole shingle sets are compared, and those of ``similarity`` or more are linked.  Rows (id, component_id, n_links); nulls, ties, repeated rows and empty tables as there.
    """
    bits = wide_radius(similarity)
    radius = bits + round(6 * math.sqrt(bits * (1 - bits / (64 * WIDE))))
    bound_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.xxhash64(text_or_empty(text_col)).alias("_key"))
    kind = dict(source.dtypes)["_id"]
    prints = materialize(source.mapInArrow(tidy(_nodes(words)), f"_id {kind}, _key long, _fp binary, number long, " + ", ".join(f"{f} long" for f in PRINTS)), "prints")
    least = [F.min("_id").alias("least"), F.min("_key").alias("key"), *(F.first(c).alias(c) for c in ("number", *PRINTS))]
    distinct = materialize(prints.groupBy(F.col("_fp").alias("fp")).agg(*least), "distinct")
    candidates = wide_links(source, distinct, words, similarity, radius, cell_limit)
    groups = components(candidates).withColumnRenamed("node", "number")
    groups = materialize(groups.unionByName(groups.select(F.col("root").alias("number"), "root").distinct()), "groups")  # the roots too
    # one text of each node by its hash; where hashes collide the sets' own nodes tell the texts apart
    wanted = groups.join(distinct, "number").select("key").distinct()
    texts = source.join(wanted, source["_key"] == wanted["key"], "left_semi").select("_text").distinct()
    links = similar_links(groups, candidates, texts, words, similarity)
    return _named(prints.select("_id", "_fp"), distinct.select("fp", "least"), links, id_col)


def _distinct_prints(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    bound_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = dict(source.dtypes)["_id"]
    prints = materialize(source.mapInArrow(tidy(_fingerprinted(words)), f"_id {kind}, _fp long"), "prints")
    return prints, materialize(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("least")), "distinct")


def _named(prints: DataFrame, distinct: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Every row with the smallest id of its component and the number of its fingerprint's links."""
    roots = components(links)
    roots = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    named = named.join(degree, "fp", "left").select(
        F.col("fp").alias("_fp"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return prints.join(named, "_fp").select(F.col("_id").alias(id_col), "_fp", "component_id", "n_links")


def link_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, cell_limit: int = 4096
) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id and n_links.

    Words are runs without white space, A-Z lower-cased; a bit of the fingerprint is set if it is
    set in over half of the XXH64 values of the ``words``-word shingles (fewer words: the whole
    sequence).  Fingerprints at ``radius`` bits at most are linked; component_id is the smallest id
    reachable, n_links the number of verified links that the fingerprint keeps to others.  Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows stay; null ids
    never become a component_id unless all ids there are null; an empty table gives an empty table.
    """
    prints, distinct = _distinct_prints(df, id_col, text_col, words)
    named = _named(prints, distinct, near_links(distinct.select("fp"), radius, cell_limit), id_col)
    return named.select(id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")

"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words (runs of letters and digits) and marks (runs of other visible characters) are hashed into
``BUCKETS`` buckets.  Each bucket has a sparse random index vector; its word vector is the sum of the
index vectors of its neighbours within two places, over all documents.  The sums are whole numbers,
so their total does not depend on the order of tasks; tasks send them in blocks of buckets, whose
size is fixed, and the finished table is broadcast (``BUCKETS`` x ``DIMS`` numbers at any corpus
size).  Documents are pooled to the mean and the deviation of their vectors and a few shape figures.
The network is trained in numpy on at most ``max_labels`` labelled documents and its probabilities
are calibrated by a temperature on the part of them that it did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, SPACED_WORD, PrefixHash, arrow_bytes, bound_batches, carried_name, materialize, mix, portions, tidy

BUCKETS, DIMS, NONZERO, REACH, BLOCK = 1 << 14, 64, 4, 2, 64
#: 1 for the bytes of words, 2 for those of marks, 0 for white space.
KIND = np.where(ALNUM_WORD, 1, np.where(SPACED_WORD, 2, 0)).astype(np.uint8)
PORTION, SEED = 1 << 21, 31
MAX_LABELS = 20_000


def tokens_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of each word or mark, in order, and whether it is a word in capitals."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = KIND[body]
    edge = np.ones(len(body), bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(body))
    token = kind[start] > 0
    start, end = start[token], end[token]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    upper = np.zeros(len(body) + 1, np.int32)
    np.cumsum((body >= 65) & (body <= 90), out=upper[1:])
    capitals = (end - start > 1) & (upper[end] - upper[start] == end - start)
    return (PrefixHash(body, SEED).of(start, end) % np.uint64(BUCKETS)).astype(np.int64), row, capitals


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's index vector."""
    raw = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, NONZERO)
    return (raw % np.uint64(DIMS)).astype(np.int64), np.where((raw >> np.uint64(40)) & np.uint64(1), 1, -1)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS, np.int64)
    for batch in batches:
        body, offsets = arrow_bytes(batch.column("_text"))
        for lo, hi in portions(offsets, PORTION):
            at = offsets[lo : hi + 1]
            bucket, row, _ = tokens_of(body[at[0] : at[-1]], at - at[0])
            for shift in range(1, REACH + 1):
                near = row[shift:] == row[:-shift]
                a, b = bucket[:-shift][near], bucket[shift:][near]
                for word, other in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        cells = np.bincount(word * DIMS + places[other, k], signs[other, k], len(total))
                        total += cells.astype(np.int64)
    table = total.reshape(-1, BLOCK * DIMS)
    some = np.flatnonzero(table.any(axis=1))
    for k in some.tolist():
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([zstandard.compress(table[k].astype("<i8").tobytes(), 1)], pa.binary())], names=["block", "sums"]
        )


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the int64 vectors of each block; there are few blocks, of fixed size."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            values = np.frombuffer(zstandard.decompress(sums.as_py()), "<i8")
            totals[block] = totals[block] + values if block in totals else values
    if totals:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1) for v in totals.values()], pa.binary())], names=["block", "sums"]
        )


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of word vectors from all texts in column _text; rows of length one or zero."""
    schema = "block int, sums binary"
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = texts.mapInArrow(tidy(_context_sums), schema).repartition(tasks, "block").mapInArrow(tidy(add_blocks), schema)
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIMS), np.int64)
    for r in sums.collect():  # BUCKETS x DIMS numbers at most
        table[r.block] += np.frombuffer(zstandard.decompress(r.sums), "<i8")
    vectors = table.reshape(BUCKETS, DIMS).astype(np.float64)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(size > 0, size, 1)).astype(np.float32)


FEATURES = 2 * DIMS + 6


def pooled(body: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One feature row per document; zeros where there is no word."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    bucket, row, capitals = tokens_of(body, offsets)
    if not len(bucket):
        return out
    counts = np.bincount(row, minlength=n)
    have = np.flatnonzero(counts)
    size = counts[have][:, None]
    pairs, often = np.unique(row * BUCKETS + bucket, return_counts=True)
    owner, bucket_of = np.divmod(pairs, BUCKETS)
    cut = np.searchsorted(owner, np.append(have, n))
    sums = np.empty((len(have), 2 * DIMS))
    for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        each, times = vectors[bucket_of[lo:hi]], often[lo:hi].astype(np.float32)
        sums[k, :DIMS] = times @ each
        sums[k, DIMS:] = times @ np.square(each)
    mean, square = sums[:, :DIMS] / size, sums[:, DIMS:] / size
    out[have, :DIMS] = mean
    out[have, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean**2, 0))
    kinds = np.bincount(owner, minlength=n)[have]
    size = size[:, 0]
    same = np.bincount(row[1:][(row[1:] == row[:-1]) & (bucket[1:] == bucket[:-1])], minlength=n)[have]
    out[have, -6] = np.log1p(size)
    out[have, -5] = kinds / size
    out[have, -4] = np.log(kinds) / np.log(size + 1)
    out[have, -3] = np.bincount(row, capitals, minlength=n)[have] / size
    out[have, -2] = same / size
    out[have, -1] = np.diff(offsets)[have] / size / 10
    return out


class Network:
    """Two layers: tanh units and a logistic output, on standardised features."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        self.temperature, self.constant = 1.0, None
        if len(np.unique(labels)) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        x, y = (features - self.mean) / self.scale, labels.astype(np.float64)
        held = rng.random(len(y)) < 0.2
        if len(np.unique(y[held])) < 2:
            held[:] = False
        shape = [(x.shape[1], hidden), (hidden,), (hidden,), ()]
        self.w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if s and len(s) == 2 else np.zeros(s) for s in shape]
        self.w[2] = rng.normal(0, 1 / np.sqrt(hidden), hidden)
        m, v, step = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape], 0
        train = np.flatnonzero(~held)
        for _ in range(epochs):
            order = rng.permutation(train)
            for at in range(0, len(order), 128):
                rows = order[at : at + 128]
                h = np.tanh(x[rows] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -40, 40))) - y[rows]) / len(rows)
                back = np.outer(d, self.w[2]) * (1 - h**2)
                step += 1
                for k, g in enumerate((x[rows].T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ d + 1e-4 * self.w[2], d.sum())):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    self.w[k] = self.w[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        check = held if held.any() else ~held
        logits, truth = self.logits(features[check]), y[check]
        grid = np.geomspace(0.5, 8, 60)
        loss = [np.logaddexp(0, -np.where(truth > 0, logits, -logits) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -40, 40)))


def _featured(vectors, keep: list[str], network=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vectors.value
        for batch in batches:
            body, offsets = arrow_bytes(batch.column("_text"))
            got = [np.zeros((0, FEATURES), np.float32)]
            for lo, hi in portions(offsets, PORTION):
                got.append(pooled(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table))
            found = np.concatenate(got)
            if network is None:
                last = pa.array([f.astype("<f4").tobytes() for f in found], pa.binary())
            else:
                last = pa.array(network.score(found.astype(np.float64)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), last], names=[*keep, "_last"])

    return run


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held_fold: int = 2,
    threshold: float = 0.7,
    max_labels: int = MAX_LABELS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, ``keep`` columns, held_out, score and predicted.

    Rows with crc32(id as text) mod ``folds`` = ``held_fold`` are held out: their labels are never
    read.  Of the other labels the ``max_labels`` with the smallest hashes of the id are used, where ids
    repeat the rows with the smallest hashes of the text; ids with several labels take the highest,
    null labels count for nothing.  Word vectors come from all
    texts.  Null and empty texts have zero features and get a score like any other; without labels
    of both kinds the score is their mean (0.5 without any); repeated rows are scored each; an
    empty table stays empty.  A kept column that is named like one made here gets ``_in`` behind its name.
    """
    spark = df.sparkSession
    bound_batches(spark)
    fold = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    # the text goes to the workers once, also where it is kept
    named = {f"_c{i}": c for i, c in enumerate((id_col, *(c for c in keep if c != text_col)))}
    carried = [F.col(c).alias(n) for n, c in named.items()]
    docs = df.select(*carried, fold(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    named |= {"_text": text_col} if text_col in keep else {}
    vectors = spark.sparkContext.broadcast(word_vectors(docs.select("_text")))
    known = labels.select(F.col(id_col).alias("_c0"), F.col(label_col).cast("double").alias("_label")).dropna()
    known = known.where(~fold(F.col("_c0"))).groupBy("_c0").agg(F.max("_label").alias("_label"))
    known = materialize(known.orderBy(F.xxhash64("_c0"), "_c0").limit(max_labels), "labels")
    types = dict(docs.dtypes)
    sample = docs.select("_c0", "_text").join(F.broadcast(known), "_c0")  # max_labels rows at most
    sample = sample.select(F.xxhash64("_text").alias("_order"), "_label", "_text")
    sample = sample.mapInArrow(tidy(_featured(vectors, ["_order", "_label"])), "_order long, _label double, _last binary")
    sample = sample.orderBy("_order", "_label", "_last").limit(max_labels)  # also where ids repeat
    rows = sorted(sample.collect(), key=lambda r: (r._order, r._label, r._last))
    features = np.array([np.frombuffer(r._last, "<f4") for r in rows], np.float64).reshape(-1, FEATURES)
    if not len(rows):
        features = np.zeros((0, FEATURES))
    network = Network(features if len(rows) else np.zeros((1, FEATURES)), np.array([r._label for r in rows]))
    columns = [*named, "held_out"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", _last double"
    done = docs.mapInArrow(tidy(_featured(vectors, columns, network)), schema).withColumnRenamed("_last", "score")
    done = done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return done.withColumnsRenamed({n: c if n == "_c0" else carried_name(c, ("held_out", "score", "predicted")) for n, c in named.items()})

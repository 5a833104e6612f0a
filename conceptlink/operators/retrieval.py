"""Vector retrieval: exact top-k per query over all rows, metadata filters, and an inverted-file index."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("l2", "cosine", "ip")
#: Queries that one pass over the index answers; their vectors are the only broadcast data.
QUERIES_A_PASS = 2048

_COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": operator.eq, "$ne": operator.ne, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le,
    "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
}


def compile_where(where: Mapping[str, Any] | None) -> Column:
    """A metadata filter as a Column: {field: value}, {field: {$op: value}}, {$and|$or: [filters]}."""
    if not where:
        return F.lit(True)
    terms = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            if not isinstance(value, Sequence) or not value:
                raise ValueError(f"{key} needs a list of filters")
            terms.append(functools.reduce(operator.and_ if key == "$and" else operator.or_, map(compile_where, value)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, Mapping):
            for op, operand in value.items():
                if op not in _COMPARISONS:
                    raise ValueError(f"unknown operator {op}; known are {sorted(_COMPARISONS)}")
                terms.append(_COMPARISONS[op](F.col(key), operand))
        else:
            terms.append(F.col(key) == value)
    return functools.reduce(operator.and_, terms)


def distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Squared Euclidean distance, cosine distance or 1 - inner product, queries x vectors."""
    inner = queries @ vectors.T
    if metric == "ip":
        return 1 - inner
    q, v = (queries**2).sum(axis=1)[:, None], (vectors**2).sum(axis=1)[None, :]
    if metric == "l2":
        return np.maximum(q + v - 2 * inner, 0)
    return 1 - inner / np.sqrt(np.maximum(q * v, 1e-300))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _least(found: pa.Table, k: int) -> pa.Table:
    """Of each query the k rows with the least distances, ties by key."""
    _, rank = np.unique(np.array(found.column("_key").to_pylist(), object), return_inverse=True)
    ids = found.column("query_id").to_numpy()
    order = np.lexsort((rank, found.column("distance").to_numpy(), ids))
    ids = ids[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    place = np.arange(len(ids)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return found.take(pa.array(order[place < k]))


def _nearest(shared, metric: str, k: int):
    """The k nearest rows of a task for each query: the partial side of the top-k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in near(batches):
            held, rows = [*held, part], rows + part.num_rows
            if rows > 4 * k * len(shared.value[0]):
                kept = _least(pa.Table.from_batches(held), k)
                held, rows = kept.to_batches(), kept.num_rows
        if rows:
            yield from _least(pa.Table.from_batches(held), k).to_batches()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            d = np.round(distances(queries, _matrix(batch.column("_v")), metric), 9)
            keys = np.array(batch.column("_key").to_pylist(), object)
            n = min(k, d.shape[1])
            rank = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
            out_q, out_at = [], []
            for i in range(len(ids)):
                limit = np.partition(d[i], n - 1)[n - 1]
                near = np.flatnonzero(d[i] <= limit)
                near = near[np.lexsort((rank[near], d[i][near]))][:n]
                out_q.append(np.full(len(near), i))
                out_at.append(near)
            at_q, at = np.concatenate(out_q), np.concatenate(out_at)
            carried = [c for c in batch.schema.names if c not in ("_key", "_v")]
            taken = [batch.column(c).take(pa.array(at)) for c in ("_key", *carried)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(ids)[at_q], pa.int64()), taken[0], pa.array(d[at_q, at]), *taken[1:]],
                names=["query_id", "_key", "distance", *carried],
            )

    return run


def top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int = 10,
    metric: str = "l2",
    where: Mapping[str, Any] | None = None,
    key: str = "expression_id",
    vector: str = "embedding",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Rows (query_id, key, ``carry``, distance, retrieval_rank): the k nearest index rows of each query.

    ``queries`` has query_id (long) and the vector column.  Queries go in passes of fixed size, each
    against all rows; every task keeps k rows per query, and ranks are made from those.
    Ties are broken by key; ranks begin at 0.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric}")
    if k < 1:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    rows = index.where(compile_where(where)).dropna(subset=[key, vector])
    rows = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_v"), *carry)
    types = dict(rows.dtypes)
    schema = ", ".join([f"query_id long, _key {types['_key']}, distance double", *(f"`{c}` {types[c]}" for c in carry)])
    found = spark.createDataFrame([], schema)
    wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).alias("_v")).dropna()
    n = wanted.count()
    passes = max(1, -(-n // QUERIES_A_PASS))
    for number in range(passes):
        block = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number)
        got = block.orderBy("query_id").collect()
        if not got:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in got]), np.array([r._v for r in got], np.float64)))
        found = found.unionByName(rows.mapInArrow(_nearest(shared, metric, k), schema))
    order = Window.partitionBy("query_id").orderBy("distance", "_key")
    ranked = found.withColumn("retrieval_rank", F.row_number().over(order)).where(F.col("retrieval_rank") <= k)
    return ranked.select("query_id", F.col("_key").alias(key), *carry, "distance", (F.col("retrieval_rank") - 1).alias("retrieval_rank"))


def retrieve(
    queries: DataFrame, index: DataFrame, k: int = 10, metric: str = "l2", where: Mapping[str, Any] | None = None
) -> DataFrame:
    """Candidates in long form: query_id, query, the expression's columns, distance, retrieval_rank."""
    carry = [c for c in index.columns if c not in ("expression_id", "embedding", "query_id", "distance")]
    hits = top_k(queries, index, k, metric, where, carry=carry)
    return hits.join(queries.select("query_id", "query"), "query_id").withColumns(
        {"rerank_score": F.lit(None).cast("double"), "rank": F.col("retrieval_rank")}
    )


class InvertedFile:
    """Approximate search: every row belongs to the list of its nearest centre; queries probe some lists.

    Centres are fitted by k-means on at most ``sample`` vectors; all rows are indexed.  By default there are as
    many lists as the square root of the rows, one for every 16 sampled vectors at most.  ``probes`` is the number
    of lists by which sampled queries find ``recall`` of their ten nearest in the sample; searches probe so many.
    """

    def __init__(self, index: DataFrame, lists: int | None = None, sample: int = 20_000, key: str = "vec_id", vector: str = "embedding", seed: int = 7, recall: float = 0.95):
        self.key, self.vector = key, vector
        if lists is None:
            lists = max(1, min(round(index.count() ** 0.5), sample // 16))
        some = index.select(key, vector).dropna().orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample).collect()
        x = np.array([r[1] for r in some], np.float64)
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else np.zeros((1, 1))
        for _ in range(10 if len(x) else 0):
            nearest = distances(x, centres, "l2").argmin(axis=1)
            for c in range(len(centres)):
                if (nearest == c).any():
                    centres[c] = x[nearest == c].mean(axis=0)
        self.centres, self.probes = centres, len(centres)
        if len(x) > 10:
            asked = x[rng.choice(len(x), min(256, len(x)), replace=False)]
            near = distances(asked, x, "l2").argpartition(10, axis=1)[:, :10]
            order = distances(asked, centres, "l2").argsort(axis=1).argsort(axis=1)  # the place of each list for a query
            places = np.take_along_axis(order, distances(x, centres, "l2").argmin(axis=1)[near], axis=1)
            self.probes = int(np.quantile(places, recall, method="higher")) + 1
        shared = index.sparkSession.sparkContext.broadcast(centres)

        @F.pandas_udf("int")
        def nearest_list(v):
            return pd.Series(distances(np.stack(v.to_numpy()), shared.value, "l2").argmin(axis=1) if len(v) else [], dtype="int32")

        self.rows = index.where(F.col(vector).isNotNull()).withColumn("list", nearest_list(vector))

    def top_k(self, queries: DataFrame, k: int = 10, probes: int | None = None, metric: str = "l2") -> DataFrame:
        """Like the exact search, over the ``probes`` nearest lists of each query."""
        probes = probes or self.probes
        shared, vector, key = queries.sparkSession.sparkContext.broadcast(self.centres), self.vector, self.key

        @F.pandas_udf("array<int>")
        def nearest_lists(v):
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list(distances(np.stack(v.to_numpy()), shared.value, "l2").argsort(axis=1)[:, :probes].astype("int32")))

        probed = queries.select("query_id", F.col(vector).alias("_q"), F.explode(nearest_lists(vector)).alias("list"))
        pairs = probed.join(self.rows.select(key, F.col(vector).alias("_v"), "list"), "list")
        d = F.round(native_distance("_q", "_v", metric), 9)
        order = Window.partitionBy("query_id").orderBy("distance", key)
        ranked = pairs.select("query_id", key, d.alias("distance")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        return ranked.select("query_id", key, "distance", (F.col("_r") - 1).alias("retrieval_rank"))


def native_distance(a: str, b: str, metric: str = "l2") -> Column:
    """The same distances as expressions over two array columns, in doubles."""
    x, y = (F.transform(c, lambda v: v.cast("double")) for c in (a, b))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    if metric == "l2":
        return total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))
    inner = total(F.zip_with(x, y, lambda p, q: p * q))
    if metric == "ip":
        return 1 - inner
    return 1 - inner / F.sqrt(total(F.transform(x, lambda v: v * v)) * total(F.transform(y, lambda v: v * v)))

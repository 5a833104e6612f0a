"""Shared pieces: tables in the shared folder, Arrow texts as byte arrays, rolling hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Byte table that lower-cases A-Z only.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 1 for the bytes of words that white space (0x09-0x0D and 0x20) separates.
SPACED_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: 1 for the bytes of words of letters, digits and non-ASCII characters.
ALNUM_WORD = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in local mode a temporary one if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="conceptlink-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, note: str, paths: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read again: lineage is cut and lost executors cost nothing.

    ``df`` is evaluated once; what nondeterministic order it had is then fixed.
    The path is added to ``paths``, for who wants to ``discard`` it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/conceptlink-{note}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``materialize`` wrote; nothing may be left that reads them."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on at most about ``most`` bytes go to a Python worker at once; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if jvm.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def tidy(run):
    """``run`` over a task's batches; then the worker, which lives on, gives its free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def carried_name(column: str, made: tuple[str, ...]) -> str:
    """The name under which an input column is carried along: one that an operator makes itself gets ``_in`` behind it."""
    return f"{column}_in" if column.lower() in made else column


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list:
    """Two longs that tell rows apart by id and text; rows alike in both share them."""
    return [
        F.xxhash64(text_or_empty(text_col)).alias("_k1"),
        F.xxhash64(F.lit(7), F.col(id_col), F.length(text_or_empty(text_col))).alias("_k2"),
    ]


def arrow_bytes(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Strings (null: empty) as one byte array and n + 1 offsets."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary()).fill_null(b"")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def portions(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``most`` bytes each; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Polynomial hashes modulo 2**64 of any substring, from one pass over the bytes.

    Bytes first go through a table of random 64-bit values, which ``seed`` chooses.
    """

    #: Powers of the base and of its inverse, of all seeds and as far as they were needed.
    _powers: tuple[np.ndarray, np.ndarray] | None = None
    BASE = 0x5851F42D4C957F2D

    def __init__(self, body: np.ndarray, seed: int) -> None:
        table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
        n, self.seed = len(body), np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        have = self._powers
        if have is None or len(have[0]) < n + 1:
            size = max(n + 1, 1 << 20)
            up, down = (np.full(size, x, np.uint64) for x in (self.BASE, pow(self.BASE, -1, 2**64)))
            up[0] = down[0] = 1
            have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if size <= 1 << 22:  # longer ones serve one very long text only
                PrefixHash._powers = have
        self.down = have[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[body] * have[0][:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + self.seed)

    def every(self, length: int) -> np.ndarray:
        """The hash of the substring of this length at each place."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + self.seed)


def word_spans(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words; ``kind`` marks word bytes. No word crosses rows."""
    inside = np.zeros(len(body) + 1, bool)
    inside[:-1] = kind[body]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends = inside[:-1] & ~inside[1:]
    last = first_of_next(offsets)
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def first_of_next(offsets: np.ndarray) -> np.ndarray:
    """The last byte of every row that has any."""
    return offsets[1:][offsets[1:] > offsets[:-1]] - 1


def lowered(body: np.ndarray) -> np.ndarray:
    return np.frombuffer(body.tobytes().translate(LOWER_BYTES), np.uint8)

"""Two-pass external shuffle into shards, with DataFrame functions only.

First pass: every record goes to the shard of the highest seeded hash of (id, shard) and, within it,
to one of the shard's buckets by another seeded hash.  The number of buckets follows from the bytes
of the table, so that a bucket fits in a task's memory.  Second pass: a Fisher-Yates shuffle of each
bucket (Spark's ``shuffle`` of an array, seeded), whose order gives the slots; the buckets' sizes give
the first slot of each.  With one more shard a record moves only if that shard's hash is the highest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried_name, materialize

MADE = ("shard", "slot", "grown_shard")
#: Bucket sizes that are broadcast, of 24 bytes each; more are joined by shuffle.
BROADCAST_BUCKETS = 100_000


def shard_of(id_col: str, shards: int, seed: int):
    """Rendezvous hashing: the shard whose hash with the id is the highest."""
    scored = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(id_col)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*scored)["s"] if shards > 1 else F.lit(0)


def shuffle_into_shards(
    df: DataFrame, id_col: str = "doc_id", size_col: str = "size", shards: int = 24, bucket_bytes: int = 8 << 20, seed: int = 5
) -> DataFrame:
    """The rows of ``df`` with shard, slot (gapless from 0 in each shard) and grown_shard.

    ``size_col`` is the bytes that a row will take in memory; all other columns are carried along.
    The shard depends on the id and the number of shards alone.  Null ids hash like a value of their
    own; rows with one id share a shard, repeated rows get a slot each; an empty table stays empty.
    A column of the input that is named like one made here comes out with ``_in`` behind its name.
    Buckets are dealt by all columns, so repeated ids spread; rows alike in every column do not.
    """
    df = df.withColumnsRenamed({c: carried_name(c, MADE) for c in df.columns})
    id_col, size_col = carried_name(id_col, MADE), carried_name(size_col, MADE)
    total = df.agg(F.sum(size_col)).first()[0] or 0
    buckets = max(1, -(-int(total) // (shards * bucket_bytes)))
    columns = df.columns
    dealt = df.select(
        shard_of(id_col, shards, seed).alias("_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), *columns), F.lit(buckets)).cast("int").alias("_bucket"),
        F.struct(*columns).alias("_row"),
    )
    # array_sort first: the seeded shuffle then has one result whatever the order of arrival
    gathered = dealt.repartition(min(shards * buckets, 10_000), "_shard", "_bucket").groupBy("_shard", "_bucket")
    # and the buckets of a task come in one order, since its generator goes on from bucket to bucket
    sorted_rows = gathered.agg(F.array_sort(F.collect_list("_row")).alias("_rows")).sortWithinPartitions("_shard", "_bucket")
    shuffled = sorted_rows.select("_shard", "_bucket", F.shuffle("_rows", seed).alias("_rows"))
    # from here on rows travel one by one, never a bucket at once
    each = shuffled.select("_shard", "_bucket", F.posexplode("_rows").alias("_at", "_row"))
    done = materialize(each.select("_shard", "_bucket", "_at", "_row.*"), "buckets")
    sizes = done.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    first = F.broadcast(first) if shards * buckets <= BROADCAST_BUCKETS else first
    slots = done.join(first, ["_shard", "_bucket"])
    return slots.select(
        *columns, F.col("_shard").alias("shard"), (F.col("_first") + F.col("_at")).alias("slot"),
    ).withColumn("grown_shard", shard_of(id_col, shards + 1, seed))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes shuffled rows as one folder per shard, in slot order within files."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Mapping of source concepts that arrive as a stream, batch by batch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..plans.mapper import ConceptMapper
from ..schemas import SOURCE


def map_stream(sources: DataFrame, mapper: ConceptMapper, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the mapped rows of each batch to Parquet; a batch that comes again replaces its own folder.

    query_id is made from the row's content and its number among equal rows of the batch, so that it does
    not depend on arrival and repeated rows are mapped each.
    """

    def write(batch: DataFrame, number: int) -> None:
        equal = Window.partitionBy(*SOURCE.names).orderBy(F.lit(0))
        named = batch.withColumn("_n", F.row_number().over(equal)).withColumn("query_id", F.xxhash64(*SOURCE.names, "_n")).drop("_n")
        mapper.map(named).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Documents that arrive as files replace the stored ones of their partition (an extension; batch ingest is the same call)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import replace_partitions


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, by: tuple[str, ...] = ("entity", "year")) -> StreamingQuery:
    """Process what is there and stop; a restart goes on after the last finished batch."""

    def upsert(batch: DataFrame, _: int) -> None:
        replace_partitions(batch, target, *by)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

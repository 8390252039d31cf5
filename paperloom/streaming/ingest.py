"""Documents that arrive as files go through the quality gate and into a table, exactly once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import quality_gate


def gated(stream: DataFrame) -> DataFrame:
    """The gate is a projection, so it runs on a stream as on a table."""
    return quality_gate(stream)


def ingest(spark: SparkSession, folder: str, schema: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files as they arrive in `folder` and writes the documents that pass, a folder per batch: a batch
    that is run again replaces what it wrote."""

    def store(batch: DataFrame, number: int) -> None:
        batch.where("is_good").write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return gated(stream).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

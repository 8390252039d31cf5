"""Proper names of documents as they arrive: counts by name in the state of a streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.layout import name_words


def follow_names(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts the names in a stream of `lines` (Text) until what is there has been read.

    The state holds a count for each name, dealt by name. Each batch writes the names that it changed, with their counts so far, to
    its own folder under `path`, which a repeated batch replaces; so a query that is stopped or dies and is started again
    with its checkpoint counts nothing twice and nothing never.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    counted = name_words(lines).groupBy("name").agg(F.count("*").alias("cnt"))
    return counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def names_so_far(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """`name, cnt` of names that occurred `least` times or more: each one's last count, which is its largest."""
    rows = spark.read.schema("name string, cnt long").option("recursiveFileLookup", True).parquet(path)
    return rows.groupBy("name").agg(F.max("cnt").alias("cnt")).where(F.col("cnt") >= least)

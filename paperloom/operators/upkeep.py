"""An index that follows its records: what is new or gone is told by texts, and all else stays as it is.

The index is a table in partitions by a hash of the text, each entry with the text's number. An update joins old and new texts on their
hash and text; texts that stay keep their numbers and vectors, new ones are numbered after the largest that is there, and only
partitions in which anything changed are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import exists
from .aggregates import global_numbers

PARTITIONS = 256
_META = "index long, base_key string, key string, text string, chunk_ids array<bigint>, embedding array<double>, part int"


def read(spark: SparkSession, path: str) -> DataFrame:
    """`index, base_key, key, text, chunk_ids, embedding, part`; an index that isn't there is empty."""
    return spark.read.schema(_META).parquet(path) if exists(spark, path) else spark.createDataFrame([], _META)


def _provenance(pairs: DataFrame) -> DataFrame:
    """`text, base_key, key, chunk_ids` from `text, base_key, key, chunk_id`: of keys the first by chunk and key."""
    first = F.min(F.struct("chunk_id", "key", "base_key"))
    rows = pairs.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("text").agg(first.alias("f"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return rows.select("text", "f.base_key", "f.key", "chunk_ids")


def update(spark: SparkSession, path: str, pairs: DataFrame, encode: Callable[[Column], Column], partitions: int = PARTITIONS) -> dict[str, int]:
    """Brings the index at `path` to `pairs` (`text, base_key, key, chunk_id`), all of the records as they are now. Returns how many
    texts are `new`, `gone`, `changed` (in where they come from) and `kept`, and the partitions `written`.

    Texts are encoded once, when they are new. An update that dies leaves partitions as they were or as they should be; run again,
    it ends as it would have, but for the numbers of new texts.
    """
    from ..session import cut_lineage, cuts, drop_cuts

    begun = cuts()
    part = F.pmod(F.xxhash64("text"), F.lit(partitions)).cast("int")
    old = read(spark, path)
    now = _provenance(pairs).withColumn("part", part)
    both = now.alias("n").join(old.alias("o"), (F.col("n.part") == F.col("o.part")) & (F.col("n.text") == F.col("o.text")), "full")
    same = F.col("n.chunk_ids").eqNullSafe(F.col("o.chunk_ids")) & F.col("n.key").eqNullSafe(F.col("o.key")) & F.col("n.base_key").eqNullSafe(F.col("o.base_key"))
    state = F.when(F.col("o.text").isNull(), "new").when(F.col("n.text").isNull(), "gone").when(same, "kept").otherwise("changed")
    merged = both.select(
        F.coalesce("n.text", "o.text").alias("text"), F.coalesce("n.part", "o.part").alias("part"), state.alias("state"), F.col("o.index").alias("index"),
        *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("base_key", "key", "chunk_ids")), F.col("o.embedding").alias("embedding"),
    )
    merged = cut_lineage(merged)  # the old index is read once, before anything is overwritten
    counts = {r.state: r.n for r in merged.groupBy("state").agg(F.count("*").alias("n")).collect()}
    touched = merged.where("state <> 'kept'").select("part").distinct()
    last = merged.agg(F.max("index")).first()[0]
    begin = 0 if last is None else last + 1
    new = merged.where("state = 'new'")
    if counts.get("new"):
        order = new.withColumn("__chunk", F.col("chunk_ids")[0])
        fresh = global_numbers(order, ["__chunk", "key", "text"], "__index", begin).select("text", "part", "__index")
        vectors = new.select("text", encode(F.col("text")).alias("__vector"))
        given = cut_lineage(fresh.join(vectors, "text"))
    else:
        given = new.select("text", "part", F.lit(0).cast("long").alias("__index"), F.lit(None).cast("array<double>").alias("__vector"))
    whole = merged.where("state <> 'gone'").join(touched, "part", "left_semi").join(given, ["text", "part"], "left")
    rows = whole.select(F.coalesce("index", "__index").alias("index"), "base_key", "key", "text", "chunk_ids", F.coalesce("embedding", "__vector").alias("embedding"), "part")
    emptied = [r.part for r in touched.join(whole.select("part").distinct(), "part", "left_anti").collect()]  # `partitions` at most
    n = touched.count()
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for p in emptied:  # dynamic overwriting leaves partitions alone that get no row
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={p}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    drop_cuts(spark, begun, keep=0)
    return {s: counts.get(s, 0) for s in ("new", "gone", "changed", "kept")} | {"written": n}

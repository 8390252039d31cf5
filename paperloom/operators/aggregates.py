"""Aggregations whose ties go to what came first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequency(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """`keys, value, cnt, first_pos` of each value that isn't null."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"), F.min(position).alias("first_pos"))


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, position: str, name: str | None = None) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first, of those at one position the least."""
    order = F.struct((-F.col("cnt")).alias("n"), "first_pos", value)
    return frequency(rows, keys, value, position).groupBy(*keys).agg(F.min_by(value, order).alias(name or value))


def ranked_frequency(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """`frequency` with `rank`, by falling count and first position."""
    w = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "first_pos")
    return frequency(rows, keys, value, position).withColumn("rank", F.row_number().over(w))


def union_sets(*columns: DataFrame) -> DataFrame:
    """The distinct rows of one-column tables, under the first one's name."""
    out = columns[0]
    for more in columns[1:]:
        out = out.union(more)
    return out.distinct()


def ordered_distinct(rows: DataFrame, value: str, position: str) -> DataFrame:
    """`value, first_pos, cnt`: each value with where it comes first."""
    return rows.groupBy(value).agg(F.min(position).alias("first_pos"), F.count("*").alias("cnt"))


#: Rows of a range that are numbered in one task, and how many ranges there may be.
RANGE_ROWS, RANGES = 500_000, 8192


def global_numbers(rows: DataFrame, order: list[str], name: str, start: int = 0, ranges: int | None = None) -> DataFrame:
    """`rows` numbered in the order of `order`, whose first column is an integer that isn't null.

    Rows are numbered inside ranges of that column, as many as the rows ask for, and the ranges' sizes give the offsets; no
    window holds all rows.
    """
    ranges = ranges or min(RANGES, max(8, -(-rows.count() // RANGE_ROWS)))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(rows.agg(F.percentile_approx(F.col(order[0]).cast("long"), shares, max(10000, 20 * ranges))).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col(order[0]))) if cuts else F.lit(0)
    ranged = rows.withColumn("__range", bucket)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))  # a row per range
    offsets = sizes.select(F.col("__range"), (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__before") + F.col("__inside") - 1 + start).cast("long")).drop("__range", "__inside", "__before")


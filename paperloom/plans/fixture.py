"""Tables derived from the driver's for the queries: documents as laid-out lines with headings, and nested order records.

The same integer arithmetic is written once for each engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROMANS = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII XXIII XXIV XXV".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, ln, x`: the lines that aren't blank."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "x"))
    rows = rows.withColumn("x", F.trim("x")).where("x <> ''")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("ln"), "x")


def document_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`text_lines` beside other columns of the documents, for plans that don't go on by document: no line moves."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", *columns, F.posexplode(lines).alias("pos", "x"))
    return rows.select("doc_id", *columns, (F.col("pos") + 1).alias("ln"), "x")


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, ln, lvl, txt, x0, x1, y1, size, flags`."""
    ln, doc = F.col("ln"), F.col("doc_id")
    rows = text_lines(spark, sf_dir).withColumn("lvl", F.when(ln % 20 == 1, 0).when(ln % 5 == 2, 1).when(ln % 5 == 4, 2))
    chapter = F.coalesce(F.get(F.array(*map(F.lit, ROMANS)), F.floor((ln - 1) / 20).cast("int")), F.lit(""))
    letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (ln % 26 + 1).cast("int"), F.lit(1))
    text = (
        F.when(F.col("lvl") == 0, F.concat(F.lit("Chương "), chapter, F.lit(". "), F.col("x")))
        .when(F.col("lvl") == 1, F.concat(F.lit("Điều "), (F.floor(ln / 5) + 1).cast("string"), F.lit(". "), F.col("x")))
        .when(F.col("lvl") == 2, F.concat(letter, F.lit(") "), F.col("x")))
        .otherwise(F.col("x"))
    )
    head = F.col("lvl") == 0
    return rows.select(
        "doc_id",
        "ln",
        "lvl",
        text.alias("txt"),
        (72 + F.when(head, 150).when(ln % 7 == 0, 20).otherwise(0)).cast("double").alias("x0"),
        F.when(ln % 4 == 0, 540 - (ln * 37 + doc * 13) % 90).otherwise(540).cast("double").alias("x1"),
        (80 + ((ln - 1) % 40) * 16 + F.when(ln % 5 == 1, 8).otherwise(0)).cast("double").alias("y1"),
        F.when(head, 14.0).when((doc + ln) % 11 == 0, 13.0).otherwise(12.0).alias("size"),
        F.when(F.col("lvl").isin(0, 1), 16).when(ln % 9 == 0, 2).otherwise(0).alias("flags"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per line, 40 lines a page."""
    box = F.struct("x0", (F.col("y1") - 12).alias("y0"), "x1", "y1")
    return laid_out(spark, sf_dir).select(
        "doc_id", F.floor((F.col("ln") - 1) / 40).cast("int").alias("page_no"), F.lit(1).alias("block_no"), F.col("ln").alias("line_no"), F.lit(1).alias("span_no"), F.col("txt").alias("text"), "size", "flags", box.alias("bbox")
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`o_orderkey, head struct, items array of struct, tags array`."""
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"), F.array_sort(F.collect_set("l_linestatus")).alias("tags"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("head"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select("o_orderkey", "head", "items", "tags")


_ROMAN_LIST = "[" + ", ".join(f"'{r}'" for r in ROMANS) + "]"

#: DuckDB's form of `laid_out`, as common table expressions.
LINES_SQL = f"""
src as (select doc_id, i as pos, trim(l[i]) as x from (select doc_id, string_split(text, chr(10)) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
l0 as (select doc_id, cast(row_number() over (partition by doc_id order by pos) as int) as ln, x from src where x <> ''),
l1 as (select *, case when ln % 20 = 1 then 0 when ln % 5 = 2 then 1 when ln % 5 = 4 then 2 end as lvl from l0),
l3 as (select doc_id, ln, lvl,
    case lvl when 0 then concat('Chương ', coalesce({_ROMAN_LIST}[cast(floor((ln - 1) / 20) as int) + 1], ''), '. ', x)
             when 1 then concat('Điều ', cast(cast(floor(ln / 5) as int) + 1 as varchar), '. ', x)
             when 2 then concat(substring('abcdefghijklmnopqrstuvwxyz', ln % 26 + 1, 1), ') ', x) else x end as txt,
    cast(72 + case when lvl = 0 then 150 when ln % 7 = 0 then 20 else 0 end as double) as x0,
    cast(case when ln % 4 = 0 then 540 - (ln * 37 + doc_id * 13) % 90 else 540 end as double) as x1,
    cast(80 + ((ln - 1) % 40) * 16 + case when ln % 5 = 1 then 8 else 0 end as double) as y1,
    case when lvl = 0 then 14.0::double when (doc_id + ln) % 11 = 0 then 13.0::double else 12.0::double end as size,
    case when lvl in (0, 1) then 16 when ln % 9 = 0 then 2 else 0 end as flags from l1)"""

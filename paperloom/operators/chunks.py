"""Hierarchical chunks from paragraphs with heading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_levels(paragraphs: DataFrame, specs: DataFrame) -> DataFrame:
    """`paragraphs` with `lvl`: the first level that has the paragraph's marker type; the last level has the body, so it never matches."""
    last = specs.groupBy("doc_id").agg(F.max("level_ord").alias("__last"))
    marks = specs.join(last, "doc_id").where("level_ord < __last").select("doc_id", "level_ord", F.explode("markers").alias("MarkerType"))
    marks = marks.groupBy("doc_id", "MarkerType").agg(F.min("level_ord").alias("lvl"))
    return paragraphs.withColumn("MarkerType", F.coalesce("MarkerType", F.lit("none"))).join(marks, ["doc_id", "MarkerType"], "left")


def hierarchical_chunks(rows: DataFrame, levels: int, order: str = "ln", text: str = "txt") -> DataFrame:
    """`doc_id, chunk, levels, content` from `doc_id, order, lvl, text`; lvl is 0 to levels - 1 for headings, null for body.

    A heading begins a chunk unless nothing stands between it and a higher one just before. A chunk's level
    texts are the last headings in force, "" where there is none; its content is its body texts in order.
    """
    doc = Window.partitionBy("doc_id").orderBy(order)
    lag = F.lag("lvl").over(doc)
    first = F.lag(order).over(doc).isNull()
    new = F.col("lvl").isNotNull() & ~first & (lag.isNull() | (lag >= F.col("lvl")))
    marked = rows.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("chunk", F.sum("__new").over(doc))
    # one order serves all levels, so a task sorts its texts once: a heading is in force unless a higher one has come since
    so_far = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = {}
    for f in range(levels):
        own = F.last(F.when((F.col("lvl") == f) & F.col(text).isNotNull(), F.struct(F.col(order).alias("at"), F.col(text).alias("t"))), ignorenulls=True).over(so_far)
        names |= {f"__l{f}": own, f"__above{f}": F.max(F.when(F.col("lvl") < f, F.col(order))).over(so_far)}
    marked = marked.withColumns(names)
    in_force = [F.when(F.coalesce(F.col(f"__l{f}.at") > F.col(f"__above{f}"), F.lit(True)), F.col(f"__l{f}.t")) for f in range(levels)]
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("lvl").isNull(), F.struct(F.col(order), F.col(text).alias("t"))))), lambda x: x["t"])
    at_end = F.max_by(F.array(*(F.coalesce(t, F.lit("")) for t in in_force)), order)
    return marked.groupBy("doc_id", "chunk").agg(at_end.alias("levels"), body.alias("content"))


def segment_filter(chunks: DataFrame) -> DataFrame:
    """The chunks whose first level is neither blank nor "none", with `Index` from 1 in each document."""
    first = F.trim(F.col("levels")[0])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk"))
    return chunks.where((first != "") & (F.lower(first) != "none")).withColumn("Index", number)

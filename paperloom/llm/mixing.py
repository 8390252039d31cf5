"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Each of its documents first gets the whole copies that are
certain, floor(target / source size). For the rest, documents are ranked by random odds divided by
inclusion odds, and one more copy goes to the first in that order, a fixed-size sample in words. Inclusion
probabilities are unequal: they fall with the root of a document's size, so that words come from more documents, and
are scaled so that the expected words make up what is left of the target.
Ranks come from a hash of the id, so reruns and other partitionings agree. The cut in each
source's order is found with two histograms of 4,096 cells, both partially aggregated, and a
window over the documents of one cell in 16 million, so a source with a third of all rows never
meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, written

WEIGHTS = (5, 2, 1)
#: A source's words are taken this many times at most.
MOST = 3
_CELLS = 4096
#: Power of a document's size that its inclusion probability falls with; at 0 those of a source are equal.
SHRINK = 0.5
#: Sources up to which their values, some 100 bytes each, are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """`doc_id, source, size`: words of each text, 0 for null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`source, source_size, target`: the words of all sources shared by weight, none above `most` times its
    size; the excess is shared again by weight until none is above.

    That fixed point is found at once: in order of size over weight the sources that stop are a prefix,
    and the first source that isn't in it gives the share of a unit of weight. One row per source meets in
    the window, not one per document. Weights repeat over the sources by code point, null last.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    named = per.withColumn("w", F.element_at(cycle, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long"))
    rank = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = named.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    # what a unit of weight gets if exactly the sources before this one stop
    unit = (F.col("total") - most * F.col("size_before")) / (F.col("all_w") - F.col("w_before"))
    rows = rows.withColumn("unit", unit).withColumn("stops", F.col("unit") * F.col("w") > most * F.col("source_size"))
    free = F.first(F.when(~F.col("stops"), F.col("unit")), ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("free", free)
    target = F.least(F.col("free") * F.col("w"), (most * F.col("source_size")).cast("double"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _order(seed: int, odds: Column) -> Column:
    """Pareto rank as a number from 0 to below 1 that grows with random odds over inclusion odds."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    q = u / (1 - u) / odds
    return q / (1 + q)


def mix(sizes: DataFrame, goals: DataFrame, seed: int = 42, odds: str | None = None) -> DataFrame:
    """`doc_id, size, source_size, target, taken` of each row of `sizes` (doc_id, source, size).

    `taken` is the document's words times its copies: those that are certain, and one more for the first
    documents in Pareto order that fit into the source's target, and for the one document that fills the rest best.
    A document's inclusion probability is proportional to size^-SHRINK. `odds` names a positive column of `sizes` that
    multiplies the odds of that. An empty
    or wordless document is never taken; a null source is a source; repeated rows each count and
    are cut one by one; rows without id share one rank, by size.
    """
    extra = [odds] if odds else []
    shrink = F.pow(F.greatest(F.col("size"), F.lit(1)).cast("double"), F.lit(-SHRINK))
    # the words expected if each document were included with its size^-SHRINK
    expected = sizes.groupBy("source").agg(F.sum(F.col("size") * shrink).alias("expected")).withColumnRenamed("source", "__source")
    goals = written(goals.join(expected, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"), "goals")
    few = goals.count() <= BROADCAST_SOURCES

    def per_source(rows: DataFrame, values: DataFrame, how: str) -> DataFrame:
        """A row per source to each of its documents; where there are few sources, without moving the documents."""
        values = values.withColumnRenamed("source", "__source")
        return rows.join(F.broadcast(values) if few else values, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")

    rows = per_source(sizes, goals, "inner")
    ratio = F.col("target") / F.col("source_size")
    # a ratio of 3 may come out a rounding error below it
    whole = F.when(F.col("source_size") > 0, F.floor(ratio + 1e-12)).otherwise(0).cast("long")
    rows = rows.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    share = F.least(F.greatest(shrink * F.col("rest") / F.greatest(F.col("expected"), F.lit(1e-9)), F.lit(1e-12)), F.lit(1 - 1e-12))
    rows = rows.withColumn("rank", _order(seed, share / (1 - share) * (F.col(odds) if odds else F.lit(1.0))))
    rows = rows.withColumn("first", F.least(F.floor(F.col("rank") * _CELLS), F.lit(_CELLS - 1)).cast("int"))
    rows = written(rows.withColumn("second", F.least(F.floor((F.col("rank") * _CELLS - F.col("first")) * _CELLS), F.lit(_CELLS - 1)).cast("int")).drop("expected", *extra), "mixing")

    def cut(rows: DataFrame, by: list[str], cell: str, name: str) -> DataFrame:
        """The cell of each group in which the running size passes `rest`, and the size before it."""
        cells = rows.groupBy(*by, cell).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
        w = Window.partitionBy(*by).orderBy(cell)
        run = cells.withColumn("upto", F.sum("s").over(w)).withColumn("under", F.col("upto") - F.col("s"))
        return run.where((F.col("under") < F.col("rest")) & (F.col("upto") >= F.col("rest"))).groupBy(*by).agg(F.min(F.struct(F.col(cell).alias("at"), F.col("under").alias("under"))).alias(name))

    rows = per_source(rows, cut(rows, ["source"], "first", "one"), "left")
    inside = rows.where(F.col("first") == F.col("one.at"))
    two = cut(inside.withColumn("rest", F.col("rest") - F.col("one.under")), ["source"], "second", "two")
    rows = per_source(rows, two, "left")
    at_cut = (F.col("first") == F.col("one.at")) & (F.col("second") == F.col("two.at"))
    # before the cut: taken; after it: not; in its cell, about one document in 16 million: by a running sum
    ahead = (F.col("first") < F.col("one.at")) | ((F.col("first") == F.col("one.at")) & (F.col("second") < F.col("two.at")))
    plain = rows.where(F.col("one").isNull() | F.col("two").isNull() | ~at_cut).withColumn("more", F.coalesce(ahead, F.col("rest") >= F.col("source_size")) & (F.col("rest") > 0))
    w = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(at_cut).withColumn("under", F.col("one.under") + F.col("two.under") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    edge = edge.withColumn("more", F.col("under") + F.col("size") <= F.col("rest")).drop("under")
    rows = written(plain.unionByName(edge).drop("one", "two", "first", "second"), "mixed")
    # what the first document that doesn't fit leaves open goes to the one whose size comes nearest to it
    gap = rows.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap"))
    off = F.abs(F.col("gap") - F.col("size"))
    spare = per_source(rows, gap, "inner").where(~F.col("more") & (F.col("size") > 0) & (off < F.col("gap")))
    last = spare.groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("rank").alias("r"), F.col("doc_id").alias("d"), F.col("size").alias("s"))).alias("last"))
    rows = per_source(rows, last, "left")
    chosen = F.coalesce((F.col("rank") == F.col("last.r")) & F.col("doc_id").eqNullSafe(F.col("last.d")) & (F.col("size") == F.col("last.s")), F.lit(False))
    taken = F.col("size") * (F.col("whole") + (F.col("more") | chosen).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """`mix` over the sizes and targets of `docs` (doc_id, text, source, any others); an empty table gives none."""
    sizes = written(sized(docs), "sizes")
    return mix(sizes, targets(sizes, weights, most), seed)


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """The documents that the mix takes, with `size, source_size, target, taken, copies` after the columns of `docs`.

    Rows that share doc_id and size share their copies. Columns of `docs` named like a result (`size`, `source_size`, `target`,
    `taken`, `copies`) are replaced; all others, whatever their names, pass.
    """
    added = ["size", "source_size", "target", "taken", "copies"]
    docs = docs.drop(*added)
    of, big = free_name(docs, "__id"), free_name(docs, "__size")
    chosen = mix_documents(docs, weights, most, seed).where("taken > 0").withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))
    chosen = chosen.groupBy("doc_id", "size").agg(*(F.max(c).alias(c) for c in added[1:])).withColumnsRenamed({"doc_id": of, "size": big})
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("size", size).join(chosen, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col("size") == F.col(big)))
    return rows.select(*docs.columns, *added)

"""The index of texts: cleaned, flattened, chosen by schema, deduplicated with provenance, embedded and normalised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..functions.vectors import normalize
from ..session import cut_lineage
from .aggregates import global_numbers
from .nested import flatten

ELIGIBLE = ("string", "array", "dict")


def eligible(pairs: DataFrame, schema: DataFrame | None) -> DataFrame:
    """The pairs whose base path has a type that is indexed; all of them without a schema."""
    if schema is None:
        return pairs
    kept = schema.where(F.col("type").isin(*ELIGIBLE)).select(F.col("path").alias("base_key"))
    return pairs.join(kept, "base_key", "left_semi")


def deduplicate(pairs: DataFrame, chunk: str = "chunk_id", order: str = "ord") -> DataFrame:
    """`base_key, text, key, chunk_ids, first_chunk, first_ord`: each text once for a base path, under its first key, with
    all chunks that have it. One partially aggregated shuffle; a text that all chunks share costs a number for each."""
    rows = pairs.withColumn("text", F.trim("text")).where("text <> ''")
    first = F.min(F.struct(F.col(chunk), F.col(order), F.col("key")))
    out = rows.groupBy("base_key", "text").agg(first.alias("f"), F.array_sort(F.collect_set(chunk)).alias("chunk_ids"))
    return out.select("base_key", "text", "f.key", "chunk_ids", F.col(f"f.{chunk}").alias("first_chunk"), F.col(f"f.{order}").alias("first_ord"))


def deduplicate_by_key(pairs: DataFrame, order: str = "ord") -> DataFrame:
    """The first pair of each base path and text that isn't blank, without where else it is."""
    rows = pairs.withColumn("text", F.trim("text")).where("text <> ''")
    kept = rows.groupBy("base_key", "text").agg(F.min(F.struct(order, "key")).alias("f"))
    return kept.select("base_key", F.col("f.key").alias("key"), "text", F.col(f"f.{order}").alias(order))


def number(entries: DataFrame) -> DataFrame:
    """`entries` with `index` from 0 in order of first occurrence. They are worked out once, and of what is written the
    counts of the ranges read one column."""
    return global_numbers(cut_lineage(entries), ["first_chunk", "first_ord", "base_key", "text"], "index")


def build(records: DataFrame, id_col: str, schema: DataFrame | None = None, encode: Callable[[Column], Column] | None = None, mode: str = "split", max_chars: int = 2000) -> DataFrame:
    """`index, base_key, key, text, chunk_ids[, embedding]` of nested records; embeddings are made of what is left
    after deduplication, and normalised."""
    pairs = flatten(records, id_col, mode).withColumn("text", clean(F.col("text"), max_chars)).withColumnRenamed(id_col, "chunk_id")
    entries = number(deduplicate(eligible(pairs, schema)))
    out = entries.select("index", "base_key", "key", "text", "chunk_ids")
    if encode is None:
        return out
    # an encoder in Python can't be inside the lambdas of the norm, so its vectors are a column first
    return out.withColumn("embedding", encode(F.col("text"))).withColumn("embedding", normalize(F.col("embedding")))

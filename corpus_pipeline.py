"""The corpus pipeline: documents without toxic, unreadable, repeated and contaminated ones, mixed to source weights.

Each stage takes what its predecessor kept and returns the documents that it keeps, with their
columns; the last adds how many copies of each the mix takes. A stage's rows are written to the shared
folder and read again, so a lost executor costs one stage at most; then what the stage made on its way is deleted.

A null text is empty: not toxic, of no language, so it goes with the second stage. Of rows that share a doc_id copies go or
stay together; a row without doc_id is never a near-duplicate. Extra columns pass, whatever their names, but those
named like what the mix adds (`size`, `source_size`, `target`, `taken`, `copies`), which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, langid, mixing, simhash, toxicity
from paperloom.llm.shared import discard, made, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"), threshold=0.5)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages that the documents name; those without a letter or in doubt go."""
    return langid.keep_known(docs, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near: 0.8 or more alike over five-word shingles, among what fingerprints or MinHash bands connect."""
    return simhash.keep_first(docs, limit=6, shingle=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), window=13)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, weights=(5, 2, 1), most=3)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Compression distances, language models and fingerprints have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    begun = made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, begun)  # what the stage read and made, now that its rows are written
    return docs

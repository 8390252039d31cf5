"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, htmltext, langid, lm, merkle, minhash, mixing, phrases, quality, simhash, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_with_edits(table(spark, sf_dir, "documents"), minhash.MinHash(functions=128, shingle=5))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), limit=3, shingle=3, seed=42)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.round_trip(table(spark, sf_dir, "conversations"), chat.Template(budget=1024, history=256))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), langid.VOCABULARY)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_lm": op2_lm, "op3_warc": op3_warc, "op4_mixing": op4_mixing, "op5_simhash": op5_simhash, "op6_chat": op6_chat, "op7_html": op7_html, "op8_language": op8_language, "op9_decontaminate": op9_decontaminate, "op10_toxicity": op10_toxicity, "op11_phrases": op11_phrases, "op12_quality": op12_quality, "op13_merkle": op13_merkle}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op13_merkle": merkle.ORACLE_SQL}

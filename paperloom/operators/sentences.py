"""Sentence boundaries learned from the corpus itself, without labels (after Kiss and Strunk, 2006).

A period ends a sentence unless the word before it is an abbreviation: a type that has a period far more often than
chance, weighed by its length, its inner periods and how often it stands without one. After an abbreviation the next word
decides: a frequent sentence starter, or a word that is otherwise in lower case, begins one. Counts are aggregates over
all words; what is learned is joined to the places where a cut is possible, as tables of whatever size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Scores from which a type is an abbreviation and a sentence starter.
ABBREVIATION, STARTER = 0.3, 30.0
_OPENING, _CLOSING = "[({\"'“‘«", "])}\"'”’»"


def core(word: Column) -> Column:
    """A word in lower case without the marks around it; inner periods stay."""
    return F.lower(F.rtrim(F.ltrim(word, F.lit(_OPENING)), F.lit(_CLOSING + ",;:.!?")))


def _words(docs: DataFrame, text: str) -> DataFrame:
    """`w, ended, middle, n`: the distinct words, each with the one before if that ends in a sentence's mark, else null, and
    whether another one stands before; `n` is how often."""
    split = F.array_remove(F.split(text, r"[\x00-\x20]+"), "")
    pairs = docs.select(split.alias("s")).select(F.explode(F.arrays_zip(F.col("s").alias("w"), F.concat(F.array(F.lit(None).cast("string")), "s").alias("before"))).alias("p")).select("p.w", "p.before")
    bare = F.rtrim("before", F.lit(_CLOSING))
    ends = F.endswith(bare, F.lit(".")) | F.endswith(bare, F.lit("!")) | F.endswith(bare, F.lit("?"))
    return pairs.where("w is not null").groupBy("w", F.when(ends, F.col("before")).alias("ended"), F.coalesce(~ends, F.lit(False)).alias("middle")).agg(F.count("*").alias("n"))


def _period(word: Column) -> Column:
    return F.coalesce(F.endswith(F.rtrim(word, F.lit(_CLOSING)), F.lit(".")), F.lit(False))


@dataclass
class Boundaries:
    """`abbreviations`: `core, score`; `openers`: `core, starter`, words that begin a sentence after an abbreviation."""

    abbreviations: DataFrame
    openers: DataFrame


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """log of p^k (1-p)^(n-k), with probabilities kept from 0 and 1."""
    q = F.greatest(F.lit(1e-12), F.least(p, F.lit(1 - 1e-12)))
    return k * F.log(q) + (n - k) * F.log(1 - q)


def learn(docs: DataFrame, text: str = "text", least: float = ABBREVIATION, starter: float = STARTER) -> Boundaries:
    """What the words of `docs` say about boundaries. Types without a letter are no abbreviations."""
    upper, lower, times = F.col("w").rlike(r"^[^\p{L}]*\p{Lu}"), F.col("w").rlike(r"^[^\p{L}]*\p{Ll}"), lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    words = _words(docs, text).select(
        core(F.col("w")).alias("core"), _period(F.col("w")).alias("dot"), lower.alias("lower"), upper.alias("upper"), "middle", "n",
        F.col("ended").isNotNull().alias("after"), core(F.col("ended")).alias("before_core"), _period(F.col("ended")).alias("before_dot"),
    )
    words = cut_lineage(words)  # read by every step below
    lettered = F.col("core").rlike(r"\p{L}")
    types = words.groupBy("core").agg(F.sum("n").alias("n"), times(F.col("dot")).alias("dots"))
    totals = types.agg(F.sum("n").alias("all"), F.sum("dots").alias("all_dots")).first()
    every, dots = float(totals["all"] or 0), float(totals["all_dots"] or 0)
    chance = F.lit(dots / every if every else 0.0)
    ratio = 2 * (_likelihood(F.col("dots"), F.col("n"), F.lit(0.99)) - _likelihood(F.col("dots"), F.col("n"), chance))
    inner = F.length("core") - F.length(F.replace("core", F.lit("."), F.lit("")))
    letters = F.length("core") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -(F.col("n") - F.col("dots")).cast("double"))
    abbreviations = types.where(lettered & (F.col("dots") > 0)).select("core", score.alias("score")).where(F.col("score") >= least)
    abbreviations = cut_lineage(abbreviations)  # of a known size, so that small ones are broadcast
    # words after a sure end of a sentence: a mark that isn't an abbreviation's period
    ended = words.where("after").join(abbreviations.select(F.col("core").alias("before_core"), F.lit(1).alias("short")), "before_core", "left")
    after = ended.where("short is null or not before_dot").groupBy("core").agg(F.sum("n").alias("k"))
    cases = words.where(lettered).groupBy("core").agg(F.sum("n").alias("n"), times(F.col("lower")).alias("lower"), times(F.col("upper") & F.col("middle")).alias("upper_inside"))
    ends = float(after.agg(F.sum("k")).first()[0] or 0)
    joined = cases.join(after, "core", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    p, p1 = F.col("n") / F.lit(every or 1.0), F.col("k") / F.lit(ends or 1.0)
    rest = F.lit(max(every - ends, 1.0))
    p2 = (F.col("n") - F.col("k")) / rest
    both = _likelihood(F.col("k"), F.lit(ends), p) + _likelihood(F.col("n") - F.col("k"), rest, p)
    apart = _likelihood(F.col("k"), F.lit(ends), p1) + _likelihood(F.col("n") - F.col("k"), rest, p2)
    is_starter = (p1 > p2) & (2 * (apart - both) >= starter)
    openers = joined.select("core", is_starter.alias("starter"), ((F.col("lower") > 0) & (F.col("upper_inside") == 0)).alias("common")).where("starter or common")
    return Boundaries(abbreviations, cut_lineage(openers.select("core", "starter")))


def split(docs: DataFrame, known: Boundaries, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, pos, sentence`: pieces between possible cuts, joined again where a cut isn't one.

    Cuts are possible where `functions.text.split_sentences` makes them. White space at a cut that isn't one becomes a
    space; sentences of up to 2 characters go; null texts have none. `key` has no repeats.
    """
    flat = F.regexp_replace(text, r"[\x00-\x1f]+", " ")
    trimmed = F.filter(F.transform(F.split(flat, r"(?<=[.!?])(?U:\s)+"), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.arrays_zip(F.col("s").alias("piece"), F.concat(F.array(F.lit(None).cast("string")), "s").alias("before"))
    rows = docs.select(key, trimmed.alias("s")).select(key, F.posexplode(pairs).alias("at", "p")).select(key, "at", "p.piece", "p.before").where("piece is not null")
    # control characters are spaces by now and pieces trimmed, so single spaces bound the words
    last, first = F.substring_index("before", " ", -1), F.substring_index("piece", " ", 1)
    rows = rows.select(key, "at", "piece", F.when(_period(last), core(last)).alias("last"), F.when(_period(last) & first.rlike(r"^[^\p{L}]*\p{Lu}"), core(first)).alias("next"))
    rows = rows.join(known.abbreviations.select(F.col("core").alias("last"), F.lit(True).alias("short")), "last", "left")
    rows = rows.join(known.openers.select(F.col("core").alias("next"), F.lit(True).alias("opens")), "next", "left")
    rows = rows.withColumn("n", F.sum(F.when(F.col("short").isNotNull() & F.col("opens").isNull(), 0).otherwise(1)).over(Window.partitionBy(key).orderBy("at")))
    piece = Window.partitionBy(key, "n").orderBy("at")
    whole = F.array_join(F.collect_list("piece").over(piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), " ")
    rows = rows.select(key, "n", whole.alias("sentence"), F.row_number().over(piece).alias("part")).where("part = 1 and length(sentence) > 2")
    number = F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1
    return rows.select(key, number.cast("long").alias("pos"), "sentence")


def learned_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`split` of `docs` by what they themselves say."""
    return split(docs, learn(docs, text), key, text)

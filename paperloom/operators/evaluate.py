"""Training-set preparation and ROUGE."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import with_stems


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def rouge_n(pairs: DataFrame, n: int, keys: list[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """`keys, precision, recall, f1` in percent with 4 places: the overlap of n-gram multisets."""

    def counted(c: str, name: str) -> DataFrame:
        words = pairs.select(*keys, tokens(F.col(c)).alias("t")).where(F.size("t") >= n)
        gram = F.col("t") if n == 1 else F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))
        return words.select(*keys, F.explode(gram).alias("g")).groupBy(*keys, "g").agg(F.count("*").alias(name))

    both = counted(prediction, "p").join(counted(reference, "r"), [*keys, "g"], "full").groupBy(*keys).agg(
        F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("m"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("r"), F.lit(0)).alias("r")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = pairs.select(*keys).join(both, keys, "left").fillna(0, ["m", "p", "r"])
    rows = rows.withColumn("precision", ratio(F.col("m"), F.col("p"))).withColumn("recall", ratio(F.col("m"), F.col("r")))
    f1 = ratio(2 * F.col("m"), F.col("p") + F.col("r"))
    return rows.select(*keys, *(F.round(x * 100, 4).alias(c) for x, c in ((F.col("precision"), "precision"), (F.col("recall"), "recall"), (f1, "f1"))))


def stemmed(pairs: DataFrame, keys: list[str], columns: tuple[str, ...] = ("prediction", "reference")) -> DataFrame:
    """`pairs` with the words of the columns stemmed, those of up to 3 letters aside, and nothing but words and line breaks between
    them; for any ROUGE. Each distinct word is stemmed once. `keys` have no repeats; null texts become empty."""
    for c in columns:
        found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+|\n"), F.lit(0))
        rows = pairs.select(*keys, F.posexplode(found).alias("at", "word"))
        stems = with_stems(rows.where(F.length("word") > 3).select("word").distinct(), "word", "stem")
        words = rows.join(stems, "word", "left").select(*keys, F.struct("at", F.coalesce("stem", "word").alias("w")).alias("x"))
        text = words.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), " ").alias("__text"))
        pairs = pairs.drop(c).join(text, keys, "left").withColumn(c, F.coalesce("__text", F.lit(""))).drop("__text")
    return pairs


def rouge_l():  # noqa: ANN201
    """A pandas UDF of two strings: the F-measure, in percent, of their longest common subsequence of words."""
    def score(a: str, b: str) -> float:
        x, y = re.findall("[a-z0-9]+", (a or "").lower()), re.findall("[a-z0-9]+", (b or "").lower())
        row = [0] * (len(y) + 1)
        for w in x:
            before = 0
            for j, v in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if w == v else max(row[j], row[j - 1])
        return round(200.0 * row[-1] / (len(x) + len(y)), 4) if x or y else 0.0

    @F.pandas_udf("double")
    def rouge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return rouge


def _words(text: str | None) -> list[str]:
    return re.findall("[a-z0-9]+", (text or "").lower())


def _common(x: list[str], y: list[str]) -> set[int]:
    """Places in x of a longest common subsequence with y."""
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, w in enumerate(x):
        for j, v in enumerate(y):
            best[i + 1, j + 1] = best[i, j] + 1 if w == v else max(best[i, j + 1], best[i + 1, j])
    found, i, j = set(), len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif best[i, j - 1] > best[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return found


def rouge_lsum():  # noqa: ANN201
    """A pandas UDF of prediction and reference: the F-measure, in percent, of ROUGE-L over lines: of each line of the
    reference the words that a longest common subsequence with any line of the prediction has, a word counting no
    more often than either text has it."""

    def score(prediction: str, reference: str) -> float:
        ours, theirs = ([w for line in (t or "").split("\n") if (w := _words(line))] for t in (prediction, reference))
        left = [Counter(w for line in t for w in line) for t in (ours, theirs)]
        hits = 0
        for line in theirs:
            for at in sorted(set().union(*(_common(line, other) for other in ours))):
                if all(c[line[at]] > 0 for c in left):
                    hits += 1
                    for c in left:
                        c[line[at]] -= 1
        n = sum(map(len, ours)) + sum(map(len, theirs))
        return round(200.0 * hits / n, 4) if n else 0.0

    @F.pandas_udf("double")
    def rouge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return rouge


#: Tokens that a model's input and its target have at most.
INPUT_TOKENS, TARGET_TOKENS = 512, 128


def tokenize(rows: DataFrame, source: str, target: str, vocabulary: str, prefix: str = "", most: tuple[int, int] = (INPUT_TOKENS, TARGET_TOKENS)) -> DataFrame:
    """`rows` with `input_ids` and `labels`: the pieces of both columns by a sentencepiece model, and its end of text,
    cut to as many as the model takes. `vocabulary` is a path that all executors can open."""

    def ids(limit: int, before: str) -> Callable[[Column], Column]:
        @F.pandas_udf("array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            end = [model.eos_id()] if model.eos_id() >= 0 else []
            for texts in batches:
                yield pd.Series([model.encode(before + (t or ""))[: limit - len(end)] + end for t in texts])

        return encode

    return rows.withColumn("input_ids", ids(most[0], prefix)(F.col(source))).withColumn("labels", ids(most[1], "")(F.col(target)))


def split_train(rows: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """`rows` with `split`, train or validation, by a hash of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000
    return rows.withColumn("split", F.when(place < int(share * 1000), "train").otherwise("validation"))


def training_pairs(rows: DataFrame, source: str, target: str) -> DataFrame:
    """The two columns, where both are there; a missing column raises."""
    if missing := {source, target} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows.select(source, target).dropna()

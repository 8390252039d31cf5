"""Porter's stemmer (1980) as columns.

A step's suffix, stem and the stem's form of vowels and consonants are columns of their own, so no expression grows with the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The algorithm's suffixes and what takes their place, in its order.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def form(word: Column) -> Column:
    """Vowels as V, consonants as C; y is a vowel after a consonant."""
    vowels = F.regexp_replace(F.regexp_replace(word, "[aeiou]", "V"), "([^V])y", "$1V")
    return F.regexp_replace(vowels, "[^V]", "C")


def _some(c: str) -> Column:
    return F.col(c).contains("VC")


def _many(c: str) -> Column:
    return F.col(c).rlike("VC+V+C")


def _short(form_: str, word: str) -> Column:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return F.col(form_).endswith("CVC") & ~F.col(word).rlike("[wxy]$")


def _doubled(form_: str, word: str) -> Column:
    return F.col(form_).endswith("CC") & (F.right(word, F.lit(1)) == F.substring(F.right(word, F.lit(2)), 1, 1)) & (F.length(word) > 1)


def _parted(rows: DataFrame, suffixes: list[str]) -> DataFrame:
    """`rows` with the longest of the suffixes that `w` has, the stem before it, and the stem's form."""
    rows = rows.withColumn("suffix", F.regexp_extract("w", f"({'|'.join(suffixes)})$", 1))
    rows = rows.withColumn("stem", F.left("w", F.length("w") - F.length("suffix")))
    return rows.withColumn("form", form(F.col("stem")))


def _mapped(table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(F.col("suffix") == k, v) for k, v in table.items()))


def with_stems(words: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """`words` with the stem of each `word`, in lower case; words of up to two letters, and words with anything but a to z, stay as
    they are. Meant for distinct words. Null stays null. A column called `name` is replaced."""
    kept = [c for c in words.columns if c != name]
    w, suffix, stem = F.col("w"), F.col("suffix"), F.col("stem")
    own = F.struct(*(F.col(c) for c in kept))
    rows = words.select(own.alias("own"), F.lower(word).alias("given")).withColumn("w", F.col("given"))
    # plurals
    rows = rows.withColumn("w", F.when(w.rlike("sses$|ies$"), F.left("w", F.length("w") - 2)).when(w.rlike("[^s]s$"), F.left("w", F.length("w") - 1)).otherwise(w))
    # -ed and -ing
    rows = _parted(rows, ["eed", "ed", "ing"])
    cut = (suffix != "") & (suffix != "eed") & F.col("form").contains("V")
    rows = rows.withColumn("w", F.when((suffix == "eed") & _some("form"), F.concat(stem, F.lit("ee"))).when(cut, stem).otherwise(w)).withColumn("cut", cut)
    rows = rows.withColumn("form", form(F.col("w")))
    one = _some("form") & ~_many("form") & _short("form", "w")
    mended = F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(_doubled("form", "w") & ~w.rlike("[lsz]$"), F.left("w", F.length("w") - 1)).when(one, F.concat(w, F.lit("e"))).otherwise(w)
    rows = rows.withColumn("w", F.when(F.col("cut"), mended).otherwise(w))
    rows = _parted(rows, ["y"])
    rows = rows.withColumn("w", F.when((suffix != "") & F.col("form").contains("V"), F.concat(stem, F.lit("i"))).otherwise(w))
    for table in (STEP_2, STEP_3):
        rows = _parted(rows, list(table))
        rows = rows.withColumn("w", F.when((suffix != "") & _some("form"), F.concat(stem, _mapped(table))).otherwise(w))
    rows = _parted(rows, STEP_4)
    rows = rows.withColumn("w", F.when((suffix != "") & _many("form") & ((suffix != "ion") | stem.rlike("[st]$")), stem).otherwise(w))
    rows = _parted(rows, ["e"])
    rows = rows.withColumn("w", F.when((suffix != "") & (_many("form") | (_some("form") & ~_short("form", "stem"))), stem).otherwise(w))
    rows = rows.withColumn("form", form(F.col("w")))
    rows = rows.withColumn("w", F.when(_many("form") & w.endswith("ll"), F.left("w", F.length("w") - 1)).otherwise(w))
    plain = F.col("given").rlike("^[a-z]{3,}$")
    return rows.select("own.*", F.when(plain, w).otherwise(F.col("given")).alias(name))

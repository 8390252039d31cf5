"""String functions on columns."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CODAS, KEYWORDS, MARKER_PATTERNS, NUCLEI, ONSETS, ROMAN


def normalize_word(word: Column) -> Column:
    """Without what is neither a letter of the Latin-to-Vietnamese range nor a digit."""
    return F.regexp_replace(word, "[^A-Za-zÀ-ỹĐđ0-9]", "")


def strip_spaces(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(strip_spaces(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def clean(text: Column, max_chars: int | None = None) -> Column:
    """Trimmed, without signs other than ( ) . , ; : - –, runs of spaces as one, cut at max_chars."""
    s = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(s, r"(?U)[^\w\s().,;:\-–]", "")
    s = F.regexp_replace(s, " {2,}", " ")
    return F.substring(s, 1, max_chars) if max_chars else s


def is_roman(text: Column) -> Column:
    return text.rlike("^[IVXLC]+$")


def roman_to_int(text: Column) -> Column:
    """Right to left, a smaller numeral than the largest so far is taken off; other signs count 0."""
    value = F.create_map(*(x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(state: Column, sign: Column) -> Column:
        v = F.coalesce(value[sign], F.lit(0))
        less = v < state["most"]
        return F.struct(F.when(less, state["total"] - v).otherwise(state["total"] + v).alias("total"), F.when(less, state["most"]).otherwise(v).alias("most"))

    return F.aggregate(F.filter(F.split(F.reverse(text), ""), lambda c: c != ""), start, step, lambda s: s["total"])


def is_abbreviation(word: Column) -> Column:
    """True unless the lower-cased word is onset, nucleus and coda of a plain Vietnamese syllable. The longest
    onset and coda are taken; toned vowels count as no letters."""
    w = F.regexp_replace(F.lower(word), "[^a-zăâêôơưđ]", "")
    one_of = lambda parts: "|".join(sorted(parts, key=lambda p: (-len(p), p)))
    # the onset is possessive: what it takes is never given back to the nucleus; no coda ends another
    return ~w.rlike(f"^(?:{one_of(ONSETS)})?+(?:{one_of(NUCLEI)})(?:{one_of(CODAS)})?$")


def case_style(word: Column) -> Column:
    """3000 for upper case, 2000 for title case, else 1000, of what normalize_word leaves."""
    w = normalize_word(word)
    title = r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*(?:[^\p{L}]+|$))+$"
    return F.when((w == F.upper(w)) & (w != F.lower(w)), 3000).when(w.rlike(title), 2000).otherwise(1000)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def build_style(word: Column, flags: Column) -> Column:
    """The case style plus 100 for bold (16), 10 for italic (2) and 1 for bit 8."""
    return case_style(word) + has_flag(flags, 16).cast("int") * 100 + has_flag(flags, 2).cast("int") * 10 + has_flag(flags, 8).cast("int")


def merge_style(style: Column) -> Column:
    """Aggregate: the least of each decimal digit."""
    digit = lambda p: F.min(F.floor(style / p) % 10) * p
    return (digit(1000) + digit(100) + digit(10) + digit(1)).cast("int")


def split_sentences(text: Column) -> Column:
    """Control characters are spaces; cut after . ! ? and white space; sentences of up to 2 characters go."""
    t = F.regexp_replace(text, r"[\x00-\x1f]+", " ")
    parts = F.transform(F.split(t, r"(?<=[.!?])(?U:\s)+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 2)


def wrap_prompt(text: Column, prefix: str = "", suffix: str = "") -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "").otherwise(F.concat(F.lit(prefix), t, F.lit(suffix)))


def query_text(text: Column) -> Column:
    """The trimmed query, null if nothing is left."""
    return F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit(""))


# --- heading markers


def marker_patterns(keywords: list[str] = KEYWORDS, patterns: list[str] = MARKER_PATTERNS) -> list[str]:
    """The patterns with the keywords filled in; one that isn't a regular expression is left out."""
    every = "|".join(re.escape(k[0].upper() + k[1:].lower()) for k in keywords) + "|" + "|".join(re.escape(k.upper()) for k in keywords)
    out = []
    for p in patterns:
        filled = p.replace("{keywords}", every)
        try:
            re.compile(filled)
        except re.error:
            continue
        out.append(filled)
    return out


def extract_marker(text: Column, patterns: list[str] | None = None) -> Column:
    """What the first matching pattern matches at the start, its white space at the end as one space; null if none."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, f"(?U){p}", 0), F.lit("")) for p in (patterns or marker_patterns())))
    return F.regexp_replace(F.regexp_replace(found, r"(?U)^\s+", ""), r"(?U)\s+$", " ")


def marker_type(marker: Column) -> Column:
    """The marker with its numbers as 123, its Roman numerals as XVI and its single letters as abc or ABC."""
    m = F.regexp_replace(marker, r"(?U)([A-Za-z0-9ĐÊÔƠƯđêôơư])\+(?=\W|$)", "$1")
    m = F.regexp_replace(m, r"(?U)\b[0-9]+\b", "123")
    m = F.regexp_replace(m, r"(?U)\b[IVXLC]+\b", "XVI")
    m = F.regexp_replace(m, r"(?U)(?<!\w)[a-zđêôơư](?!\w)", "abc")
    return F.regexp_replace(m, r"(?U)(?<!\w)[A-ZĐÊÔƠƯ](?!\w)", "ABC")


def is_bullet(marker: Column) -> Column:
    return F.coalesce(marker, F.lit("")).rlike(r"^\s*[-•●♦▪‣–—]+\s*$")


def similar_ratio():  # noqa: ANN201
    """A pandas UDF of two strings: the Ratcliff-Obershelp ratio, which no built-in function gives."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio

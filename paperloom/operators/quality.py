"""The text quality gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import QUALITY_MESSAGES, VALID_CHARACTERS


@dataclass(frozen=True)
class Limits:
    invalid: float = 0.2
    whitespace: float = 0.2
    short_lines: float = 0.3
    characters: int = 300
    #: Code points below which a line is short.
    short: int = 10


#: What ends a line.
_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _short_line(least: int) -> str:
    """A line that isn't blank, and without white space around it has fewer than `least` code points."""
    more = rf"(?:.{{0,{least - 3}}}\S)?" if least > 2 else ""
    return rf"(?Us)\A\s*+\S{more}\s*+\z" if least > 1 else r"(?!)"


def quality_gate(pages: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:  # noqa: B008
    """`pages` with `is_good, check_mess, total_chars, invalid_ratio, whitespace_ratio, short_line_ratio`.

    A blank text has no characters; any other counts one line break more. Below the least length there are
    no ratios. The first reason in the order invalid, white space, short lines is the message; ratios
    are compared as they are and shown with 3 places.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    whole = F.when(t.rlike(r"(?U)\S"), F.concat(t, F.lit("\n"))).otherwise("")
    counted = pages.withColumns(
        {
            "total_chars": F.length(whole),
            "__bad": F.length(F.regexp_replace(whole, f"(?U)[{VALID_CHARACTERS}]++", "")),
            "__wide": F.regexp_count(whole, F.lit(" {3,}")),
            "__split": F.split(whole, _BREAK),
        }
    )
    # a line decides by its first characters, where a pattern over the text would look at all of them
    held = lambda pattern: F.size(F.filter("__split", lambda x: x.rlike(pattern)))
    counted = counted.withColumns({"__lines": held(r"(?U)\S"), "__short": held(_short_line(limits.short))})
    long = F.col("total_chars") >= limits.characters
    ratios = {
        "invalid_ratio": F.when(long, F.col("__bad") / F.col("total_chars")),
        "whitespace_ratio": F.when(long, F.col("__wide") / F.col("total_chars")),
        "short_line_ratio": F.when(long, F.col("__short") / F.greatest(F.col("__lines"), F.lit(1))),
    }
    m = QUALITY_MESSAGES
    rated = counted.withColumns(ratios).withColumn(
        "check_mess",
        F.when(~long, m["short"])
        .when(F.col("invalid_ratio") > limits.invalid, m["invalid"])
        .when(F.col("whitespace_ratio") > limits.whitespace, m["space"])
        .when(F.col("short_line_ratio") > limits.short_lines, m["lines"])
        .otherwise(m["good"]),
    )
    shown = {c: F.round(c, 3) for c in ratios}
    return rated.withColumns(shown).withColumn("is_good", F.col("check_mess") == m["good"]).drop("__bad", "__wide", "__split", "__lines", "__short")

"""Lines to paragraphs: adjacent-row predicates, then gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import merge_style
from ..functions.vectors import round_half_up


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("Line")


def _before(c: str) -> Column:
    return F.lag(c).over(_doc())


def same_style(part: Column | None = None) -> Column:
    """Any of the line, first-word and last-word styles agrees with the line before (`part`: of a part of the style)."""
    cut = (lambda s: s) if part is None else (lambda s: s % part)
    line, first = F.col("Style"), F.col("Words.First.Style")
    was = _before("Style"), _before("Words.Last.Style")
    return (cut(was[0]) == cut(line)) | (cut(was[0]) == cut(first)) | (cut(was[1]) == cut(line)) | (cut(was[1]) == cut(first))


def same_font_style() -> Column:
    """As same_style, of the part below the case digit."""
    return same_style(F.lit(1000))


def same_case() -> Column:
    """As same_style: the case of a style isn't looked at apart from the rest of it."""
    return same_style()


def near() -> Column:
    """The gap above is below twice that of the line before, below twice the one under it (or that is 3 at most), and below five heights."""
    top, bot = F.col("Top"), F.col("Bot")
    return (top < _before("Top") * 2) & ((top < bot * 2) | (bot <= 3.0)) & (top < F.col("LineHeight") * 5)


def can_merge() -> Column:
    """Whether a line continues the paragraph of the line before it. No alignment is ever "right", so no bad alignment is left to test for."""
    marked = F.col("MarkerText").isNotNull() & ~F.col("MarkerText").isin("", " ")
    font = F.abs(_before("FontSize") - F.col("FontSize")) <= 0.7
    was = _before("Align")
    align = (was == F.col("Align")) | was.isin("Justify", "Center", "Right") | ((was == "Left") & (F.col("Align") == "Justify"))
    return F.coalesce(~marked & font & same_style() & near() & align, F.lit(False))


def paragraph_ids(lines: DataFrame) -> DataFrame:
    """`lines` with `Paragraph`, counted from 1."""
    return lines.withColumn("__new", (~can_merge()).cast("int")).withColumn("Paragraph", F.sum("__new").over(_doc()).cast("int")).drop("__new")


def build(lines: DataFrame) -> DataFrame:
    """`doc_id, Paragraph, Text, MarkerText, MarkerType, Style, FontSize, Align` from numbered lines.

    The font size is the only mode, else the mode nearest to the document's common size, of equally near
    ones the first; the alignment is the mode, the first seen of equals.
    """
    keys = ["doc_id", "Paragraph"]
    # all windows are inside a document, as those that made the lines, so that nothing is read or moved twice
    often = lambda name, *by: {f"__n{name}": F.count("*").over(Window.partitionBy(*by)), f"__p{name}": F.min("Line").over(Window.partitionBy(*by))}
    rows = lines.select(*keys, "Line", "Text", "MarkerText", "MarkerType", "Style", "FontSize", "Align")
    rows = rows.withColumns(often("s", *keys, "FontSize")).withColumns(often("a", *keys, "Align")).withColumns(often("d", "doc_id", "FontSize"))
    first = lambda c, *by: F.when(F.col(c).isNotNull(), F.struct(*by, F.col(c).alias("c")))  # noqa: E731 - what isn't there is never the mode
    rows = rows.withColumn("__common", F.min_by("FontSize", first("FontSize", (-F.col("__nd")).alias("n"), F.col("__pd").alias("p"))).over(Window.partitionBy("doc_id")))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("Line", "Text"))), lambda x: x["Text"]), " ")
    built = rows.where("__common is not null").groupBy(*keys).agg(
        texts.alias("Text"),
        F.min_by(F.struct("MarkerText", "MarkerType"), "Line").alias("__m"),
        merge_style(F.col("Style")).alias("Style"),
        F.min_by("FontSize", F.struct((-F.col("__ns")).alias("n"), F.abs(F.col("FontSize") - F.col("__common")).alias("d"), F.col("__ps").alias("p"))).alias("__size"),
        F.min_by("Align", first("Align", (-F.col("__na")).alias("n"), F.col("__pa").alias("p"))).alias("Align"),
    )
    return built.where("Align is not null").select(*keys, "Text", F.col("__m.MarkerText").alias("MarkerText"), F.col("__m.MarkerType").alias("MarkerType"), "Style", round_half_up(F.col("__size")).alias("FontSize"), "Align")


def merge(lines: DataFrame) -> DataFrame:
    return build(paragraph_ids(lines))


def merge_text(rows: DataFrame, keys: list[str], order: str, text: str = "Text", name: str = "text") -> DataFrame:
    """The trimmed texts that aren't empty, in order, joined by single line breaks."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("t")))), lambda x: F.trim(F.coalesce(x["t"], F.lit(""))))
    joined = F.array_join(F.filter(parts, lambda t: t != ""), "\n")
    return rows.groupBy(*keys).agg(F.trim(F.regexp_replace(joined, "\n{2,}", "\n")).alias(name))

"""From text spans with boxes to lines with typography, position and alignment.

Every window is partitioned by doc_id, so one shuffle on it serves the whole chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import round_half_up
from .aggregates import ranked_frequency

PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("Line")


def span_lines(spans: DataFrame) -> DataFrame:
    """`doc_id, Line, Text, spans` from `doc_id, page_no, block_no, line_no, span_no, text, size, flags, bbox`.

    A line's text is its spans' in order, trimmed; blank lines go; numbers run through a document's pages.
    """
    place = ["doc_id", "page_no", "block_no", "line_no"]
    ordered = F.sort_array(F.collect_list(F.struct("span_no", "text", "size", "flags", "bbox")))
    rows = spans.groupBy(*place).agg(ordered.alias("spans"))
    rows = rows.withColumn("Text", F.trim(F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), "")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "block_no", "line_no"))
    return rows.where("Text <> ''").select("doc_id", number.alias("Line"), "Text", "spans")


def worded_spans(spans: Column) -> Column:
    """A line's spans that have words: `words, size, flags, bbox`."""
    split = F.transform(spans, lambda s: F.struct(tx.words(s["text"]).alias("words"), s["size"].alias("size"), s["flags"].alias("flags"), s["bbox"].alias("bbox")))
    return F.filter(split, lambda s: F.size(s["words"]) > 0)


def line_features(lines: DataFrame, full_case_style: bool = False, exceptions: Sequence[str] = ()) -> DataFrame:
    """Marker, style, font size, first and last word and box of each line of `span_lines`.

    The case part of a line's style is 1000; with `full_case_style` it is the least of its words' case styles,
    abbreviations and the words in `exceptions`, in whatever case, left out.
    """
    rows = lines.withColumn("__w", worded_spans(F.col("spans")))

    def word(i: int) -> Column:
        w = F.try_element_at("__w", F.lit(i))
        own = F.try_element_at(w["words"], F.lit(i))
        return F.struct(
            F.coalesce(own, F.lit("")).alias("Text"),
            F.coalesce(tx.build_style(own, w["flags"]), F.lit(0)).alias("Style"),
            round_half_up(F.coalesce(w["size"], F.lit(12.0))).alias("FontSize"),
        )

    # over words, which share their span's size
    mean = F.aggregate("__w", F.lit(0.0), lambda s, w: s + w["size"] * F.size(w["words"])) / F.aggregate("__w", F.lit(0), lambda s, w: s + F.size(w["words"]))
    some = F.size("__w") > 0
    every = lambda bit: F.forall("spans", lambda s: tx.has_flag(s["flags"], bit)).cast("int")
    case = F.lit(1000)
    if full_case_style:
        known = [e.lower() for e in exceptions]
        plain = F.filter(F.flatten(F.transform("__w", lambda s: s["words"])), lambda w: ~tx.is_abbreviation(w) & ~F.lower(tx.normalize_word(w)).isin(known))
        case = F.coalesce(F.array_min(F.transform(plain, tx.case_style)), F.lit(1000))
    x0 = F.when(some, round_half_up(F.element_at("__w", 1)["bbox"]["x0"])).otherwise(0.0)
    x1 = F.when(some, round_half_up(F.element_at("__w", -1)["bbox"]["x1"])).otherwise(0.0)
    low = F.when(some, round_half_up(F.array_min(F.transform("__w", lambda w: w["bbox"]["y0"])))).otherwise(0.0)
    high = F.when(some, round_half_up(F.array_max(F.transform("__w", lambda w: w["bbox"]["y1"])))).otherwise(0.0)
    marker = tx.extract_marker(F.col("Text"))
    out = rows.withColumn("MarkerText", marker)
    return out.select(
        "doc_id",
        "Line",
        "Text",
        "MarkerText",
        tx.marker_type(F.col("MarkerText")).alias("MarkerType"),
        (case + every(16) * 100 + every(2) * 10 + every(8)).alias("Style"),
        F.when(some, F.bround(mean * 2) / 2).otherwise(12.0).alias("FontSize"),
        F.struct(word(1).alias("First"), word(-1).alias("Last")).alias("Words"),
        F.struct(x0.alias("X0"), x1.alias("X1"), round_half_up((x0 + x1) / 2).alias("XM"), low.alias("Y0"), high.alias("Y1")).alias("Coords"),
    )


def roman_run_fix(lines: DataFrame, mode: str = "marker", replace_with: str = "ABC") -> DataFrame:
    """`lines` with MarkerType's Roman numeral as `replace_with` where a type's leading Roman markers aren't a gapless run
    without repeats; with mode "text", those of MarkerText and Text too."""
    if mode not in ("marker", "text"):
        raise ValueError(f"no such mode: {mode}")
    numeral = F.nullif(F.regexp_extract("MarkerText", r"(?U)\b([IVXLC]+)\b", 1), F.lit(""))
    marked = F.col("MarkerType").isNotNull() & (F.col("MarkerText") != "")
    by = Window.partitionBy("doc_id", "MarkerType")
    rows = lines.withColumn("__n", F.when(marked, tx.roman_to_int(numeral)))
    other = F.max(F.when(marked & F.col("__n").isNull(), 1).otherwise(0)).over(by.orderBy("Line"))
    rows = rows.withColumn("__lead", marked & (other == 0))
    mine = F.when(F.col("__lead"), F.col("__n"))
    count, least, most = F.count(mine).over(by), F.min(mine).over(by), F.max(mine).over(by)
    distinct = F.size(F.collect_set(mine).over(by))
    good = (count == most - least + 1) & (count == distinct)
    # the types are windows' keys, so what is wrong is settled before any of them changes
    rows = rows.withColumn("__wrong", F.col("__lead") & ~good)
    names = ("MarkerType",) if mode == "marker" else ("MarkerType", "MarkerText", "Text")
    fixed = {c: F.when(F.col("__wrong"), F.regexp_replace(c, r"(?U)\b[IVXLC]+\b", replace_with)).otherwise(F.col(c)) for c in names}
    return rows.withColumns(fixed).drop("__n", "__lead", "__wrong")


def page_sizes(pages: DataFrame) -> DataFrame:
    """`doc_id, pageWidth, pageHeight` of each document's first page, from `doc_id, page_no, width, height`."""
    return pages.groupBy("doc_id").agg(F.min_by(F.struct("width", "height"), "page_no").alias("s")).select("doc_id", F.col("s.width").cast("double").alias("pageWidth"), F.col("s.height").cast("double").alias("pageHeight"))


#: The text region's columns.
REGION = ("xStart", "yStart", "xEnd", "yEnd", "xMid", "yMid", "regionWidth", "regionHeight")


def with_region(lines: DataFrame, page_width: float = PAGE_WIDTH, sizes: DataFrame | None = None) -> DataFrame:
    """`lines` with their document's text region. All windows are inside a document, so one shuffle on it serves them, and
    those of the steps before and after."""
    width = F.lit(float(page_width))
    if sizes is not None:
        lines, width = lines.join(sizes.select("doc_id", F.col("pageWidth").alias("__width")), "doc_id", "left"), F.coalesce("__width", width)
    x0, x1 = F.col("Coords.X0"), F.col("Coords.X1")
    doc = Window.partitionBy("doc_id")

    def common(x: Column, there: Column, name: str) -> dict[str, Column]:
        """How often a value occurs and where first, to take the most frequent, the first of equals."""
        same = Window.partitionBy("doc_id", x)
        return {f"__n{name}": F.sum(there.cast("int")).over(same), f"__p{name}": F.min(F.when(there, F.col("Line"))).over(same)}

    def mode(x: Column, there: Column, name: str) -> Column:
        return F.min_by(x, F.when(there, F.struct((-F.col(f"__n{name}")).alias("n"), F.col(f"__p{name}").alias("p"), x.alias("x")))).over(doc)

    left, right = x0.isNotNull(), F.coalesce(x1 >= 0.75 * width, F.lit(False))
    rows = lines.withColumns(common(x0, left, "l")).withColumns(common(x1, right, "r"))
    rows = rows.withColumns(
        {
            "xStart": mode(x0, left, "l"),
            "yStart": F.min("Coords.Y0").over(doc),
            "xEnd": F.coalesce(mode(x1, right, "r"), F.max(x1).over(doc)),
            "yEnd": F.max("Coords.Y1").over(doc),
        }
    )
    rows = rows.withColumns(
        {
            "xMid": round_half_up((F.col("xStart") + F.col("xEnd")) / 2),
            "yMid": round_half_up((F.col("yStart") + F.col("yEnd")) / 2),
            "regionWidth": round_half_up(F.col("xEnd") - F.col("xStart")),
            "regionHeight": round_half_up(F.col("yEnd") - F.col("yStart")),
        }
    )
    return rows.drop("__nl", "__pl", "__nr", "__pr", "__width")


def page_coords(lines: DataFrame, page_width: float = PAGE_WIDTH, sizes: DataFrame | None = None) -> DataFrame:
    """A row per document: the text region, `xStart, yStart, xEnd, yEnd, xMid, yMid, regionWidth, regionHeight`. A document
    that `sizes` (as `page_sizes` gives them) hasn't is `page_width` wide."""
    rows = with_region(lines.select("doc_id", "Line", "Coords"), page_width, sizes)
    return rows.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in REGION))


def common_markers(rows: DataFrame, order: str = "Line") -> DataFrame:
    """`doc_id, MarkerType, cnt, rank`: of each document's ten most frequent marker types those of at least 0.5% of its rows;
    of paragraphs that many, rounded down, or one."""
    least = F.greatest(F.lit(1), F.floor(F.col("total") * 0.005)) if order == "Paragraph" else F.col("total") * 0.005
    counted = rows.groupBy("doc_id", "MarkerType").agg(F.count("*").alias("cnt"), F.min(order).alias("first_pos"))
    counted = counted.withColumn("total", F.sum("cnt").over(Window.partitionBy("doc_id"))).where("MarkerType <> ''")
    by_count = Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "first_pos")
    return counted.withColumn("rank", F.row_number().over(by_count)).where((F.col("rank") <= 10) & (F.col("cnt") >= least)).select("doc_id", "MarkerType", "cnt", "rank")


def common_font_sizes(rows: DataFrame, order: str = "Line") -> DataFrame:
    """`doc_id, FontSize, cnt, rank`, most frequent first; rank 1 is the common size."""
    return ranked_frequency(rows, ["doc_id"], "FontSize", order).select("doc_id", "FontSize", "cnt", "rank")


def positions(lines: DataFrame, region: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """`lines` with line size, offsets from the region, gaps to the neighbours and alignment. The region is that of
    `page_coords`, found on the way if it isn't given."""
    c = lambda n: F.col(f"Coords.{n}")
    rows = with_region(lines, sizes=sizes) if region is None else lines.join(region.select("doc_id", "xStart", "xEnd", "xMid", "regionWidth"), "doc_id")
    rows = rows.withColumns(
        {
            "LineWidth": round_half_up(c("X1") - c("X0")),
            "LineHeight": round_half_up(c("Y1") - c("Y0")),
            "Left": round_half_up(c("X0") - F.col("xStart")),
            "Right": round_half_up(F.col("xEnd") - c("X1")),
            "Mid": round_half_up(c("XM") - F.col("xMid")),
            "Top": F.coalesce(round_half_up(c("Y1") - F.lag(c("Y1")).over(_doc())), F.lit(0.0)),
            "Bot": F.coalesce(round_half_up(F.lead(c("Y1")).over(_doc()) - c("Y1")), F.lit(0.0)),
        }
    )
    slack = 0.01 * F.col("regionWidth")
    align = F.when(F.abs("Mid") <= slack, F.when(F.col("Left") > slack, "Center").otherwise("Justify")).when(F.col("Mid") > slack, "Right").otherwise("Left")
    return rows.withColumn("Align", align).drop(*REGION)


def repair_gaps(lines: DataFrame, columns: tuple[str, ...] = ("Top", "Bot")) -> DataFrame:
    """`lines` with negative gaps, as page breaks leave them, replaced by the least of the repaired gap before and the raw one after."""
    for c in columns:
        g = F.col(c)
        rows = lines.withColumn("__next", F.lead(g).over(_doc())).withColumn("__run", F.sum((g >= 0).cast("int")).over(_doc()))
        run = Window.partitionBy("doc_id", "__run")
        before = F.max(F.when(g >= 0, g)).over(run)
        after = F.min(F.when(g < 0, F.col("__next"))).over(run.orderBy("Line"))
        lines = rows.withColumn("__fixed", F.when(g >= 0, g).otherwise(F.coalesce(F.least(before, after), g))).drop(c, "__next", "__run").withColumnRenamed("__fixed", c)
    return lines


def name_words(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`by, name`: each occurrence of a title-case word that isn't its line's first."""
    found = F.regexp_extract_all("Text", F.lit("[A-Za-zÀ-ỹĐđ0-9]+"), F.lit(0))
    rows = lines.select(*by, F.explode(F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))).alias("name"))
    # title case is all that counts, so an upper-case word of one letter is one too
    title = F.col("name").rlike(r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*(?:[^\p{L}]+|$))+$")
    return rows.where(title)


def proper_names(lines: DataFrame, least: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """`name, cnt`: title-case words, but each line's first, that occur `least` times or more (by document with `by`)."""
    return name_words(lines, by).groupBy(*by, "name").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def recomputed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Common font sizes and markers of paragraphs, in place of those of lines."""
    return common_font_sizes(rows, "Paragraph"), common_markers(rows, "Paragraph")


def extract(spans: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The whole chain: lines with features, Roman runs checked, positions, repaired gaps and single spaces. `pages` has the
    pages' sizes."""
    lines = roman_run_fix(line_features(span_lines(spans)))
    placed = repair_gaps(positions(lines, sizes=None if pages is None else page_sizes(pages)))
    word = lambda n: F.col(f"Words.{n}").withField("Text", tx.strip_spaces(F.col(f"Words.{n}.Text")))
    return placed.withColumns(
        {"Text": tx.strip_spaces(F.col("Text")), "MarkerText": tx.strip_spaces(F.col("MarkerText")), "Words": F.struct(word("First").alias("First"), word("Last").alias("Last"))}
    ).drop("Coords")

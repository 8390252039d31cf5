"""The registered queries on the driver's tables, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.constants import CODAS, NUCLEI, ONSETS, QUALITY_MESSAGES, VALID_CHARACTERS, VOWELS
from ..operators import aggregates, chunks, evaluate, index, layout, nested, paragraphs, quality, search, structure, summarize
from ..session import cut_lineage
from .fixture import LINES_SQL, document_lines, laid_out, order_records, spans, table, text_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- text functions over the documents' words and texts

_WORDS_SQL = r"words as (select distinct unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as word from documents)"
_NORM = "regexp_replace(word, '[^A-Za-zÀ-ỹĐđ0-9]', '', 'g')"
_CASE = r"case when {w} = upper({w}) and {w} <> lower({w}) then 3000 when regexp_matches({w}, '^[^\p{{L}}]*(\p{{Lu}}\p{{Ll}}*([^\p{{L}}]+|$))+$') then 2000 else 1000 end"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()


@query(f"with {_WORDS_SQL} select word, {_NORM} as normalized from words")
def text_normalize_words(spark, d):
    return _words(spark, d).select("word", tx.normalize_word(F.col("word")).alias("normalized"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def text_strip_spaces(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.strip_spaces(F.col("text")).alias("text"))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^\p{L}\p{M}\p{N}_\s().,;:\-–]', '', 'g'), ' {2,}', ' ', 'g') as text from documents")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean(F.col("text")).alias("text"))


@query(r"select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as words from documents")
def text_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words"))


@query(f"with {_WORDS_SQL} select word, {_CASE.format(w=_NORM)} as style from words")
def text_case_style(spark, d):
    return _words(spark, d).select("word", tx.case_style(F.col("word")).alias("style"))


@query(f"""with t as (select p_partkey, p_partkey % 400 as n from part),
r as (select p_partkey, repeat('C', n // 100) || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] as numeral, n from t)
select p_partkey, numeral, regexp_matches(numeral, '^[IVXLC]+$') as roman, cast(n as int) as value from r""")
def text_roman_to_int(spark, d):
    n = F.col("p_partkey") % 400
    tens = F.array(*map(F.lit, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]))
    ones = F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]))
    numeral = F.concat(F.repeat(F.lit("C"), F.floor(n / 100).cast("int")), F.get(tens, (F.floor(n / 10) % 10).cast("int")), F.get(ones, (n % 10).cast("int")))
    return table(spark, d, "part").select("p_partkey", numeral.alias("numeral")).select("p_partkey", "numeral", tx.is_roman(F.col("numeral")).alias("roman"), tx.roman_to_int(F.col("numeral")).alias("value"))


def _case_chain(parts: list[str], test: str) -> str:
    return "case " + " ".join(f"when {test.format(p=p)} then '{p}'" for p in sorted(parts, key=lambda p: (-len(p), p))) + " else '' end"


@query(f"""with {_WORDS_SQL}, a as (select word, regexp_replace(lower(word), '[^a-zăâêôơưđ]', '', 'g') as w from words),
b as (select *, {_case_chain(ONSETS, "starts_with(w, '{p}')")} as onset from a), c as (select *, substring(w, length(onset) + 1) as rest from b),
e as (select *, {_case_chain(CODAS, "suffix(rest, '{p}')")} as coda from c), f as (select *, left(rest, length(rest) - length(coda)) as nucleus from e)
select word, w = '' or (onset = '' and rest <> '' and not regexp_matches(rest, '^[{VOWELS}]')) or nucleus not in ({", ".join(f"'{n}'" for n in NUCLEI)}) as abbreviation from f""")
def text_abbreviation(spark, d):
    return _words(spark, d).select("word", tx.is_abbreviation(F.col("word")).alias("abbreviation"))


@query(r"""with t as (select doc_id, regexp_replace(regexp_replace(text, '[\x00-\x1f]+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g') as t from documents),
s as (select doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x)), lambda x: length(x) > 2) as l from t)
select doc_id, i - 1 as pos, l[i] as sentence from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from s)""")
def sentence_split(spark, d):
    return summarize.sentences(table(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query("select conv_id, turn, case when trim(coalesce(text, '')) = '' then '' else concat('summarize: ', trim(text), ' </s>') end as prompt from conversations")
def prompt_wrap(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.wrap_prompt(F.col("text"), "summarize: ", " </s>").alias("prompt"))


@query("select item_id, nullif(trim(coalesce(text, '')), '') as query from benchmark where trim(coalesce(text, '')) <> ''")
def query_trim(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.query_text(F.col("text")).alias("query")).where("query is not null")


@query("select conv_id, trim(regexp_replace(string_agg(trim(text), chr(10) order by turn), chr(10) || '{2,}', chr(10), 'g')) as text from conversations where trim(coalesce(text, '')) <> '' group by conv_id")
def merge_text(spark, d):
    return paragraphs.merge_text(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query()
def similar_ratio(spark, d):
    """Neighbouring turns of a conversation, by Ratcliff and Obershelp's ratio."""
    rows = table(spark, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = rows.withColumn("before", before).where("before is not null")
    return pairs.select("conv_id", "turn", tx.similar_ratio()("before", "text").alias("ratio"))


# --- markers


def _sql(text: str) -> str:
    return text.replace("'", "''")


_FOUND = "coalesce(" + ", ".join(f"nullif(regexp_extract(txt, '{_sql(p)}', 0), '')" for p in tx.marker_patterns()) + ")"
_TOKENS = r"regexp_extract_all(regexp_replace(MarkerText, '([A-Za-z0-9ĐÊÔƠƯđêôơư])\+([^\p{L}\p{N}_]|$)', '\1\2', 'g'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
_TYPE = f"""array_to_string(list_transform({_TOKENS}, lambda t: case when regexp_full_match(t, '[0-9]+') then '123' when regexp_full_match(t, '[IVXLC]+') then 'XVI'
    when regexp_full_match(t, '[a-zđêôơư]') then 'abc' when regexp_full_match(t, '[A-ZĐÊÔƠƯ]') then 'ABC' else t end), '')"""
_MARKED = rf"""{LINES_SQL}, m0 as (select *, regexp_replace({_FOUND}, '\s+$', ' ') as MarkerText from l3),
marked as (select *, case when MarkerText is not null then {_TYPE} end as MarkerType from m0)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    rows = laid_out(spark, d).withColumn("MarkerText", tx.extract_marker(F.col("txt")))
    return rows.withColumn("MarkerType", tx.marker_type(F.col("MarkerText")))


@query(f"with {_MARKED} select doc_id, ln, MarkerText, MarkerType from marked")
def marker_extract(spark, d):
    return _marked(spark, d).select("doc_id", "ln", "MarkerText", "MarkerType")


_TOP = """(select *, row_number() over (partition by doc_id order by cnt desc, fp) as rank from (select doc_id, MarkerType, count(*) as cnt, min(ln) as fp from marked where MarkerType <> '' group by 1, 2))"""


@query(f"with {_MARKED} select doc_id, MarkerType, cnt, rank from {_TOP} t join (select doc_id, count(*) as total from marked group by 1) using (doc_id) where rank <= 10 and cnt >= total * 0.005")
def common_markers(spark, d):
    return layout.common_markers(_marked(spark, d), "ln").select("doc_id", "MarkerType", F.col("cnt"), F.col("rank").cast("long").alias("rank"))


@query(rf"""with {_MARKED}, a as (select doc_id, ln, MarkerText, MarkerType, nullif(regexp_extract(regexp_replace(MarkerText, '([\p{{L}}\p{{N}}_]+)', ' \1 ', 'g'), ' ([IVXLC]+) ', 1), '') as num from marked where MarkerType is not null),
b as (select *, max(case when num is null then 1 else 0 end) over (partition by doc_id, MarkerType order by ln) as other from a),
v as (select *, case when num is not null and other = 0 then (select sum(case when n < coalesce(nx, 0) then -n else n end) from (select n, lead(n) over (order by i) as nx from (select i, case substring(num, i, 1) when 'I' then 1 when 'V' then 5 when 'X' then 10 when 'L' then 50 when 'C' then 100 end as n from (select unnest(range(1, length(num) + 1)) as i)))) end as val from b),
g as (select doc_id, MarkerType, count(val) as c, count(distinct val) as u, min(val) as lo, max(val) as hi from v group by 1, 2)
select m.doc_id, m.ln, case when v.val is not null and not (g.c = g.hi - g.lo + 1 and g.c = g.u) then replace(m.MarkerType, 'XVI', 'ABC') else m.MarkerType end as MarkerType
from marked m left join v on v.doc_id = m.doc_id and v.ln = m.ln left join g on g.doc_id = m.doc_id and g.MarkerType = m.MarkerType""")
def roman_run_fix(spark, d):
    return layout.roman_run_fix(_marked(spark, d).withColumnRenamed("ln", "Line")).select("doc_id", F.col("Line").alias("ln"), "MarkerType")


# --- quality

_M = QUALITY_MESSAGES
_GATE = rf"""with p as (select doc_id, case when trim(regexp_replace(text, '\s+', ' ', 'g')) = '' then '' else text || chr(10) end as t from documents),
q as (select doc_id, length(t) as total_chars, length(regexp_replace(t, '[{_sql(VALID_CHARACTERS)}]', '', 'g')) as bad, len(regexp_extract_all(t, ' {{3,}}')) as wide,
  list_filter(list_transform(string_split_regex(t, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '') as lines from p),
r as (select doc_id, total_chars, case when total_chars >= 300 then bad / total_chars end as a, case when total_chars >= 300 then wide / total_chars end as b,
  case when total_chars >= 300 then len(list_filter(lines, lambda x: length(x) < 10)) / greatest(len(lines), 1) end as c from q),
gate as (select *, case when total_chars < 300 then '{_M["short"]}' when a > 0.2 then '{_M["invalid"]}' when b > 0.2 then '{_M["space"]}' when c > 0.3 then '{_M["lines"]}' else '{_M["good"]}' end as check_mess from r)"""


@query(f"{_GATE} select doc_id, total_chars, round(a, 3) as invalid_ratio, round(b, 3) as whitespace_ratio, round(c, 3) as short_line_ratio, check_mess, check_mess = '{_M['good']}' as is_good from gate")
def quality_gate(spark, d):
    rows = quality.quality_gate(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("total_chars").cast("long").alias("total_chars"), "invalid_ratio", "whitespace_ratio", "short_line_ratio", "check_mess", "is_good")


@query(f"{_GATE} select check_mess, quality, count(*) as cnt from gate join labels using (doc_id) group by 1, 2")
def quality_verdict_counts(spark, d):
    rows = quality.quality_gate(table(spark, d, "documents").select("doc_id", "text"))
    return rows.join(table(spark, d, "labels"), "doc_id").groupBy("check_mess", "quality").agg(F.count("*").alias("cnt"))


@query(rf"""with {LINES_SQL}, w as (select unnest(regexp_extract_all(x, '[A-Za-zÀ-ỹĐđ0-9]+')[2:]) as name from l0)
select name, count(*) as cnt from w where regexp_matches(name, '^[^\p{{L}}]*(\p{{Lu}}\p{{Ll}}*([^\p{{L}}]+|$))+$') group by 1 having count(*) >= 10""")
def proper_names(spark, d):
    return layout.proper_names(text_lines(spark, d).withColumnRenamed("x", "Text"), 10)


# --- aggregates


@query("select l_orderkey, l_quantity from (select l_orderkey, l_quantity, row_number() over (partition by l_orderkey order by count(*) desc, min(l_linenumber), l_quantity) as r from lineitem group by 1, 2) where r = 1")
def mode_first_seen(spark, d):
    return aggregates.mode_first_seen(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber")


@query("select l_returnflag, l_quantity, count(*) as cnt, min(l_orderkey) as first_pos, row_number() over (partition by l_returnflag order by count(*) desc, min(l_orderkey), l_quantity) as rank from lineitem group by 1, 2")
def freq_table(spark, d):
    rows = aggregates.frequency(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_orderkey")
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("cnt"), "first_pos", "l_quantity")
    return rows.withColumn("rank", F.row_number().over(w).cast("long"))


@query("select row_number() over (order by o_orderkey) - 1 as idx, o_orderkey from orders")
def global_numbering(spark, d):
    return aggregates.global_numbers(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "idx")


@query("select row_number() over (order by s_nationkey, s_acctbal, s_suppkey) as place, s_suppkey from supplier")
def sort_records(spark, d):
    rows = aggregates.global_numbers(table(spark, d, "supplier"), ["s_nationkey", "s_acctbal", "s_suppkey"], "place", 1)
    return rows.select("place", "s_suppkey")


@query("select distinct name from (select n_name as name from nation union all select r_name from region union all select c_mktsegment from customer)")
def set_union(spark, d):
    return aggregates.union_sets(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select("r_name"), table(spark, d, "customer").select("c_mktsegment"))


@query("select event_type, min(event_id) as first_pos, count(*) as cnt from events group by 1")
def ordered_distinct(spark, d):
    return aggregates.ordered_distinct(table(spark, d, "events"), "event_type", "event_id")


# --- layout

_STYLE_OF = "({case}) + (flags & 16 <> 0)::int * 100 + (flags & 2 <> 0)::int * 10 + (flags & 8 <> 0)::int"
_FEATURES = rf"""{_MARKED}, f0 as (select *, list_filter(string_split_regex(txt, '\s+'), lambda w: w <> '') as ws from marked),
f1 as (select *, {_NORM.replace("word", "ws[1]")} as w1, {_NORM.replace("word", "ws[-1]")} as w2 from f0),
feat as (select doc_id, ln as Line, trim(txt) as Text, MarkerText, MarkerType, {_STYLE_OF.format(case="1000")} as Style, floor(size * 2 + 0.5) / 2 as FontSize,
  ws[1] as first_text, {_STYLE_OF.format(case=_CASE.format(w="w1"))} as first_style, ws[-1] as last_text, {_STYLE_OF.format(case=_CASE.format(w="w2"))} as last_style,
  x0, x1, (x0 + x1) / 2 as xm, y1 - 12 as y0, y1 from f1)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    return layout.line_features(layout.span_lines(spans(spark, d)))


@query(f"with {_FEATURES} select doc_id, Line, Text, MarkerText, MarkerType, Style, FontSize, first_text, first_style, last_text, last_style, x0, x1, floor(xm * 10 + 0.5) / 10 as xm, y0, y1 from feat")
def line_features(spark, d):
    c = lambda n, a: F.col(n).alias(a)
    return _features(spark, d).select(
        "doc_id", "Line", "Text", "MarkerText", "MarkerType", "Style", "FontSize", c("Words.First.Text", "first_text"), c("Words.First.Style", "first_style"), c("Words.Last.Text", "last_text"), c("Words.Last.Style", "last_style"),
        c("Coords.X0", "x0"), c("Coords.X1", "x1"), c("Coords.XM", "xm"), c("Coords.Y0", "y0"), c("Coords.Y1", "y1"),
    )


def _mode_sql(value: str, where: str, name: str) -> str:
    return f"(select doc_id, {value} as {name} from (select doc_id, {value}, row_number() over (partition by doc_id order by count(*) desc, min(Line)) as r from feat {where} group by 1, 2) where r = 1)"


_REGION = f"""{_FEATURES}, region0 as (select e.doc_id, a.xStart, e.yStart, coalesce(b.xr, e.most) as xEnd, e.yEnd from
(select doc_id, min(y0) as yStart, max(y1) as yEnd, max(x1) as most from feat group by 1) e join {_mode_sql("x0", "", "xStart")} a using (doc_id) left join {_mode_sql("x1", "where x1 >= 446.25", "xr")} b using (doc_id)),
region as (select doc_id, xStart, yStart, xEnd, yEnd, floor((xStart + xEnd) / 2 * 10 + 0.5) / 10 as xMid, floor((yStart + yEnd) / 2 * 10 + 0.5) / 10 as yMid, xEnd - xStart as regionWidth, yEnd - yStart as regionHeight from region0)"""


@query(f"with {_REGION} select * from region")
def page_coords(spark, d):
    return layout.page_coords(_features(spark, d))


_PLACED = f"""{_REGION}, pl0 as (select f.*, x1 - x0 as LineWidth, y1 - y0 as LineHeight, x0 - xStart as "Left", xEnd - x1 as "Right", floor((floor(xm * 10 + 0.5) / 10 - xMid) * 10 + 0.5) / 10 as Mid,
  coalesce(y1 - lag(y1) over (partition by doc_id order by Line), 0) as "Top", coalesce(lead(y1) over (partition by doc_id order by Line) - y1, 0) as Bot, regionWidth from feat f join region using (doc_id)),
placed as (select *, case when abs(Mid) <= 0.01 * regionWidth then case when "Left" > 0.01 * regionWidth then 'Center' else 'Justify' end when Mid > 0.01 * regionWidth then 'Right' else 'Left' end as Align from pl0)"""
_OUT = 'doc_id, Line, LineWidth, LineHeight, "Left" as left_gap, "Right" as right_gap, Mid as mid_gap, "Top" as top_gap, Bot as bot_gap, Align'


def _placed(spark: SparkSession, d: str) -> DataFrame:
    lines = _features(spark, d)
    return layout.positions(lines)


def _gaps(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "Line", "LineWidth", "LineHeight", F.col("Left").alias("left_gap"), F.col("Right").alias("right_gap"), F.col("Mid").alias("mid_gap"), F.col("Top").alias("top_gap"), F.col("Bot").alias("bot_gap"), "Align")


@query(f"with {_PLACED} select {_OUT} from placed")
def line_position_align(spark, d):
    return _gaps(_placed(spark, d))


def _repair_sql(source: str, column: str, name: str) -> str:
    return f"""{name}0 as (select *, lead({column}) over (partition by doc_id order by Line) as nx, sum(case when {column} >= 0 then 1 else 0 end) over (partition by doc_id order by Line) as run from {source}),
{name} as (select * exclude (nx, run) replace (case when {column} >= 0 then {column} else coalesce(least(max(case when {column} >= 0 then {column} end) over (partition by doc_id, run), min(case when {column} < 0 then nx end) over (partition by doc_id, run order by Line)), {column}) end as {column}) from {name}0)"""


_REPAIRED = f"""{_PLACED}, {_repair_sql("placed", '"Top"', "r1")}, {_repair_sql("r1", "Bot", "repaired")}"""


@query(f"with {_REPAIRED} select {_OUT} from repaired")
def gap_repair(spark, d):
    return _gaps(layout.repair_gaps(_placed(spark, d)))


_MERGED = f"""{_REPAIRED}, b0 as (select *, lag(FontSize) over w as pf, lag(Style) over w as ps, lag(last_style) over w as pl, lag("Top") over w as pt, lag(Align) over w as pa from repaired window w as (partition by doc_id order by Line)),
b1 as (select *, coalesce((MarkerText is null or MarkerText in ('', ' ')) and abs(pf - FontSize) <= 0.7 and (ps = Style or ps = first_style or pl = Style or pl = first_style)
  and "Top" < pt * 2 and ("Top" < Bot * 2 or Bot <= 3.0) and "Top" < LineHeight * 5 and (pa = Align or pa in ('Justify', 'Center', 'Right') or (pa = 'Left' and Align = 'Justify')), false) as joins from b0),
para as (select *, cast(sum(case when joins then 0 else 1 end) over (partition by doc_id order by Line) as int) as Paragraph from b1)"""


def _para(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs.paragraph_ids(layout.repair_gaps(_placed(spark, d)))


@query(f"with {_MERGED} select doc_id, Line, Paragraph from para")
def paragraph_merge(spark, d):
    return _para(spark, d).select("doc_id", "Line", "Paragraph")


_BUILT = f"""{_MERGED}, c as (select doc_id, FontSize as common from (select doc_id, FontSize, row_number() over (partition by doc_id order by count(*) desc, min(Line)) as r from para group by 1, 2) where r = 1),
s0 as (select doc_id, Paragraph, FontSize, count(*) as n, min(Line) as p from para group by 1, 2, 3),
s1 as (select *, max(n) over (partition by doc_id, Paragraph) as most from s0),
s2 as (select doc_id, Paragraph, FontSize from (select s1.*, row_number() over (partition by doc_id, Paragraph order by abs(FontSize - common), p) as r from s1 join c using (doc_id) where n = most) where r = 1),
a2 as (select doc_id, Paragraph, Align from (select doc_id, Paragraph, Align, row_number() over (partition by doc_id, Paragraph order by count(*) desc, min(Line)) as r from para group by 1, 2, 3) where r = 1),
t as (select doc_id, Paragraph, string_agg(Text, ' ' order by Line) as Text, min(Line) as l, cast(min(Style // 1000) * 1000 + min(Style // 100 % 10) * 100 + min(Style // 10 % 10) * 10 + min(Style % 10) as int) as Style from para group by 1, 2),
built as (select t.doc_id, t.Paragraph, t.Text, para.MarkerText, para.MarkerType, t.Style, s2.FontSize, a2.Align from t join para on para.doc_id = t.doc_id and para.Line = t.l join s2 on s2.doc_id = t.doc_id and s2.Paragraph = t.Paragraph join a2 on a2.doc_id = t.doc_id and a2.Paragraph = t.Paragraph)"""


@query(f"with {_BUILT} select * from built")
def paragraph_build(spark, d):
    return paragraphs.build(_para(spark, d))


# --- structure and chunks

_SEQ = """seq0 as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as b from events),
seq as (select user_id, row_number() over (partition by user_id order by ts, event_id) as pos, event_type as m from seq0 where b is null or b <> event_type)"""


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.drop_repeats(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), F.col("event_type").alias("m"))


@query(f"with {_SEQ} select user_id, cast(pos as int) as pos, m from seq")
def adjacent_dedup(spark, d):
    return _sequence(spark, d)


def _grams_sql(n: int) -> str:
    leads = ", ".join(f"lead(m, {i}) over (partition by user_id order by pos) as m{i}" for i in range(n))
    last, distinct = f"m{n - 1}", " and ".join(f"m{i} <> m{j}" for i in range(n) for j in range(i))
    none = "".join(f" and m{i} <> 'none'" for i in range(n - 1))
    return f"(select user_id, concat_ws(' > ', {', '.join(f'm{i}' for i in range(n))}) as structure, concat_ws(' > ', {', '.join(f'm{i}' for i in range(n - 1))}) as prefix, count(*) as cnt, min(pos) as fp from (select user_id, pos, {leads} from seq) where {last} is not null and {distinct}{none} group by all)"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("structure", F.array_join("structure", " > "))


@query(f"with {_SEQ} select user_id, structure, cnt from {_grams_sql(2)}")
def sequence_ngrams_2(spark, d):
    return _shown(structure.ngrams(_sequence(spark, d), ["user_id"], ["pos"], "m", 2)).select("user_id", "structure", "cnt")


@query(f"with {_SEQ} select user_id, structure, cnt from {_grams_sql(3)}")
def sequence_ngrams_3(spark, d):
    return _shown(structure.ngrams(_sequence(spark, d), ["user_id"], ["pos"], "m", 3)).select("user_id", "structure", "cnt")


def _depth_sql(n: int) -> str:
    return f"""g{n} as (select *, min(cnt) over (partition by user_id) as lo, max(cnt) over (partition by user_id) as hi from {_grams_sql(n)} g where exists (select 1 from d{n - 1} p where p.user_id = g.user_id and p.structure = g.prefix)),
d{n} as (select user_id, structure, cnt, fp from g{n} where not (cnt = lo and cnt <> hi))"""


#: Depths that the SQL is written out for; the engine goes on to the number of distinct types, of which events have five.
_DEPTHS = 6
_MINED = f"""{_SEQ}, d1 as (select user_id, m as structure, count(*) as cnt, min(pos) as fp from seq group by 1, 2), {", ".join(map(_depth_sql, range(2, _DEPTHS + 1)))},
mined as (select *, 1 as depth from d1 {" ".join(f"union all select *, {n} from d{n}" for n in range(2, _DEPTHS + 1))}),
best as (select * from (select *, row_number() over (partition by user_id, depth, list_sort(string_split(structure, ' > ')) order by cnt desc, fp) as r from mined) where r = 1)"""


def _mined(spark: SparkSession, d: str) -> DataFrame:
    return structure.build_structures(_sequence(spark, d), ["user_id"], ["pos"], "m")


@query(f"with {_MINED} select user_id, depth, structure, cnt from mined")
def structure_build(spark, d):
    return _shown(_mined(spark, d)).select("user_id", "depth", "structure", "cnt")


@query(f"with {_MINED} select user_id, depth, structure, cnt from best")
def structure_dedup(spark, d):
    return _shown(structure.deduplicate(_mined(spark, d), ["user_id"])).select("user_id", "depth", "structure", "cnt")


@query(f"with {_MINED}, t as (select *, max(depth) over (partition by user_id) as md from best), u as (select *, max(cnt) over (partition by user_id) as mc from t where depth = md) select user_id, depth, structure, cnt from u where cnt = mc")
def structure_top(spark, d):
    return _shown(structure.select_top(structure.deduplicate(_mined(spark, d), ["user_id"]), ["user_id"])).select("user_id", "depth", "structure", "cnt")


@query()
def level_mining(spark, d):
    """Each document's level names and markers, mined from its paragraphs' marker types."""
    rows = cut_lineage(paragraphs.build(_para(spark, d)).select("doc_id", "Paragraph", "MarkerText", "MarkerType"))  # read three times
    common = layout.common_markers(rows, "Paragraph")
    sequence = structure.marker_sequence(rows, common)
    mined = structure.deduplicate(structure.build_structures(sequence, ["doc_id"], ["pos"], "marker"), ["doc_id"])
    return structure.level_specs(mined)


_CHUNKS = f"""{LINES_SQL}, k0 as (select *, lag(lvl) over w as pl, lag(ln) over w as pn from l3 window w as (partition by doc_id order by ln)),
k1 as (select *, sum(case when lvl is not null and pn is not null and (pl is null or pl >= lvl) then 1 else 0 end) over (partition by doc_id order by ln) as chunk,
  sum(case when lvl < 1 then 1 else 0 end) over (partition by doc_id order by ln) as a1, sum(case when lvl < 2 then 1 else 0 end) over (partition by doc_id order by ln) as a2 from k0),
k2 as (select *, last_value(case when lvl = 0 then txt end ignore nulls) over (partition by doc_id order by ln) as t0, last_value(case when lvl = 1 then txt end ignore nulls) over (partition by doc_id, a1 order by ln) as t1,
  last_value(case when lvl = 2 then txt end ignore nulls) over (partition by doc_id, a2 order by ln) as t2 from k1),
ch as (select doc_id, chunk, coalesce(arg_max(coalesce(t0, ''), ln), '') as level1, arg_max(coalesce(t1, ''), ln) as level2, arg_max(coalesce(t2, ''), ln) as article, coalesce(string_agg(case when lvl is null then txt end, chr(10) order by ln), '') as content from k2 group by 1, 2)"""


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return chunks.hierarchical_chunks(laid_out(spark, d).select("doc_id", "ln", "lvl", "txt"), 3)


def _levels(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"level1": F.col("levels")[0], "level2": F.col("levels")[1], "article": F.col("levels")[2], "content": F.array_join("content", "\n")})


@query(f"with {_CHUNKS} select doc_id, cast(chunk as bigint) as chunk, level1, level2, article, content from ch")
def hier_chunks(spark, d):
    return _levels(_chunked(spark, d)).select("doc_id", "chunk", "level1", "level2", "article", "content")


@query(f"with {_CHUNKS} select doc_id, cast(row_number() over (partition by doc_id order by chunk) as int) as idx, level1, level2, article, content from ch where trim(level1) <> '' and lower(trim(level1)) <> 'none'")
def segment_filter(spark, d):
    return _levels(chunks.segment_filter(_chunked(spark, d))).select("doc_id", F.col("Index").alias("idx"), "level1", "level2", "article", "content")


@query(f"""with {_MARKED}, spec as (select * from (values (0, 'Chương XVI. '), (1, 'Điều 123. '), (2, 'abc) '), (3, 'none')) t(o, m))
select doc_id, ln, (select min(o) from spec where o < 3 and m = coalesce(MarkerType, 'none')) as lvl from marked""")
def level_lookup(spark, d):
    spec = spark.createDataFrame([(0, ["Chương XVI. "]), (1, ["Điều 123. "]), (2, ["abc) "]), (3, ["none"])], "level_ord int, markers array<string>")
    rows = _marked(spark, d).drop("lvl")
    specs = rows.select("doc_id").distinct().join(F.broadcast(spec))  # four rows
    return chunks.assign_levels(rows, specs).select("doc_id", "ln", "lvl")


# --- nested records

_ITEMS = """rec as (select o_orderkey, o_orderstatus as status, o_orderpriority as priority, items, tags from orders join (select l_orderkey, list(l_linenumber order by l_linenumber, l_partkey) as ln,
  list({'line': l_linenumber, 'part': l_partkey, 'flag': l_returnflag} order by l_linenumber, l_partkey, l_returnflag) as items, list_sort(list(distinct l_linestatus)) as tags from lineitem group by 1) on l_orderkey = o_orderkey)"""


@query(f"""with {_ITEMS}, u as (select *, unnest(range(0, len(items))) as i from rec), g as (select *, unnest(range(0, len(tags))) as i from rec)
select o_orderkey, 0 as ord, 'head.status' as base_key, 'head.status' as key, status as text from rec union all select o_orderkey, 1, 'head.priority', 'head.priority', priority from rec
union all select o_orderkey, cast(2 + 3 * i as int), 'items.line', 'items[' || i || '].line', cast(items[i + 1].line as varchar) from u
union all select o_orderkey, cast(3 + 3 * i as int), 'items.part', 'items[' || i || '].part', cast(items[i + 1].part as varchar) from u
union all select o_orderkey, cast(4 + 3 * i as int), 'items.flag', 'items[' || i || '].flag', items[i + 1].flag from u
union all select o_orderkey, cast(2 + 3 * len(items) + i as int), 'tags', 'tags[' || i || ']', tags[i + 1] from g""")
def json_flatten_split(spark, d):
    return nested.flatten(order_records(spark, d), "o_orderkey", "split")


@query(f"with {_ITEMS} select o_orderkey, 0 as ord, 'head.status' as base_key, 'head.status' as key, status as text from rec union all select o_orderkey, 1, 'head.priority', 'head.priority', priority from rec union all select o_orderkey, 2, 'tags', 'tags', array_to_string(tags, chr(10)) from rec")
def json_flatten_join(spark, d):
    return nested.flatten(order_records(spark, d).drop("items"), "o_orderkey", "join")


@query("select distinct * from (select path, type from (values ('head', 'object'), ('head.status', 'string'), ('head.priority', 'string'), ('items', 'array'), ('items.line', 'number'), ('items.part', 'number'), ('items.flag', 'string'), ('tags', 'array')) t(path, type), (select 1 from orders limit 1))")
def json_schema_types(spark, d):
    return nested.infer_types(order_records(spark, d), "union", ("o_orderkey",))


_SEEN = "select event_type as path, case when event_id % 5 = 0 then 'null' when event_type = 'click' and event_id % 2 = 0 then 'number' else 'string' end as type from events"


@query(f"select path, case when count(distinct nullif(type, 'null')) = 0 then 'null' when count(distinct nullif(type, 'null')) = 1 then max(nullif(type, 'null')) else 'mixed' end as type from ({_SEEN}) group by 1")
def type_merge(spark, d):
    kind = F.when(F.col("event_id") % 5 == 0, "null").when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0), "number").otherwise("string")
    return nested.merge_types(table(spark, d, "events").select(F.col("event_type").alias("path"), kind.alias("type")))


@query(f"with {_ITEMS} select o_orderkey, status, array_to_string(list_transform(items, lambda x: x.line || '/' || x.flag), ',') as items from rec")
def json_drop_fields(spark, d):
    rows = nested.drop_columns(order_records(spark, d), ["PART", "Priority", "tags"])
    shown = F.array_join(F.transform("items", lambda x: F.concat(x["line"].cast("string"), F.lit("/"), x["flag"])), ",")
    return rows.select("o_orderkey", F.col("head.status").alias("status"), shown.alias("items"))


@query(f"with {_ITEMS} select o_orderkey, priority, array_to_string(list_transform(items, lambda x: x.part), ',') as parts, '[]' as missing from rec")
def json_path_get(spark, d):
    rows = order_records(spark, d)
    parts = F.array_join(F.transform(nested.by_path(rows, "items.part"), lambda x: x.cast("string")), ",")
    return rows.select("o_orderkey", nested.by_path(rows, "head.priority").alias("priority"), parts.alias("parts"), nested.by_path(rows, "items.none.x").cast("string").alias("missing"))


# --- index and search


@query(f"""with {LINES_SQL}, p as (select source as base_key, doc_id, ln as ord, trim(x) as text from l0 join documents using (doc_id)),
e as (select base_key, text, min({{'d': doc_id, 'o': ord}}) as f, list_sort(list(distinct doc_id)) as ids from p group by 1, 2)
select row_number() over (order by f.d, f.o, base_key, text) - 1 as idx, base_key, 'line[' || f.o || ']' as key, text, array_to_string(ids, ',') as chunk_ids from e""")
def dedup_provenance(spark, d):
    rows = document_lines(spark, d, "source").withColumnRenamed("source", "base_key")
    pairs = rows.select("base_key", F.col("doc_id").alias("chunk_id"), F.col("ln").alias("ord"), F.concat(F.lit("line["), F.col("ln").cast("string"), F.lit("]")).alias("key"), F.col("x").alias("text"))
    entries = index.number(index.deduplicate(pairs))
    return entries.select(F.col("index").alias("idx"), "base_key", "key", "text", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("index"), "embedding", "label")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100."""
    return _vectors(spark, d).where("index % 100 = 0").select(F.col("index").alias("query_id"), "embedding")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 4) as norm, round((embedding::double[])[1] / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 4) as first from embeddings")
def vec_normalize(spark, d):
    rows = table(spark, d, "embeddings").withColumn("unit", vx.normalize(F.col("embedding")))
    return rows.select("vec_id", F.round(vx.norm(F.col("embedding")), 4).alias("norm"), F.round(F.col("unit")[0], 4).alias("first"))


_HITS = """v as (select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n, label from embeddings),
sc as (select q.vec_id as query_id, i.vec_id as idx, round(list_inner_product(q.e, i.e) / (q.n * i.n), 6) as s, i.label from v q, v i where q.vec_id % 100 = 0),
hits as (select query_id, idx, s, label, row_number() over (partition by query_id order by s desc, idx) as rank from sc)"""


@query(f"with {_HITS} select query_id, idx, round(s, 4) as score, cast(rank as int) as rank from hits where rank <= 20")
def vec_topk_batch(spark, d):
    return search.top_k(_asked(spark, d), _vectors(spark, d), 20).select("query_id", F.col("index").alias("idx"), F.round("score", 4).alias("score"), "rank")


@query(f"with {_HITS} select idx, round(s, 4) as score, cast(rank as int) as rank from hits where query_id = 0 and rank <= 20")
def vec_topk(spark, d):
    """One query vector, that of id 0."""
    one = _vectors(spark, d).where("index = 0").select(F.col("index").alias("query_id"), "embedding")
    return search.top_k(one, _vectors(spark, d), 20).select(F.col("index").alias("idx"), F.round("score", 4).alias("score"), "rank")


@query(f"with {_HITS}, n as (select query_id, label, count(*) as c, min(rank) as r from hits where rank <= 5 group by 1, 2) select query_id, label from (select *, row_number() over (partition by query_id order by c desc, r) as k from n) where k = 1")
def knn_classify(spark, d):
    return search.classify(_asked(spark, d), _vectors(spark, d), "label", 5)


_BAG = "list_distinct(list_filter(string_split_regex(lower({t}), '[^a-zà-ỹđ0-9]+'), lambda w: w <> ''))"
_RERANKED = f"""{_HITS}, h as (select query_id, idx, rank, {_BAG.format(t="q.text")} as a, {_BAG.format(t="t.text")} as b from hits join documents q on q.doc_id = query_id join documents t on t.doc_id = idx where rank <= 20 and trim(t.text) <> ''),
rr as (select query_id, idx, rank, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 4) as rerank_score from h),
reranked as (select *, row_number() over (partition by query_id order by rerank_score desc, rank) as new_rank from rr)"""


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    entries = docs.select(F.col("doc_id").alias("index"), F.lit("text").alias("key"), "text", F.array("doc_id").alias("chunk_ids"))
    hits = search.with_entries(search.top_k(_asked(spark, d), _vectors(spark, d), 20), entries)
    return search.rerank(hits, docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), 10)


@query(f"with {_RERANKED} select query_id, idx, rerank_score, cast(new_rank as int) as new_rank from reranked where new_rank <= 10")
def rerank_overlap(spark, d):
    return _reranked(spark, d).select("query_id", F.col("index").alias("idx"), "rerank_score", "new_rank")


_LOOKED = f"""{_HITS}, x as (select query_id, rank, unnest([idx % 40, idx * 3 % 40 + 1]) as cid, unnest([0, 1]) as p from hits where rank <= 10),
f as (select query_id, cid, min({{'r': rank, 'p': p}}) as f from x group by 1, 2), o as (select query_id, cid, row_number() over (partition by query_id order by f.r, f.p) as place from f),
looked as (select query_id, cid as chunk_id, place, n_name, n_regionkey from o join nation on n_nationkey + 1 = cid where place <= 6)"""


def _looked(spark: SparkSession, d: str) -> DataFrame:
    hits = search.top_k(_asked(spark, d), _vectors(spark, d), 10)
    hits = hits.withColumn("chunk_ids", F.array(F.col("index") % 40, F.col("index") * 3 % 40 + 1))
    nation = table(spark, d, "nation").withColumn("chunk_id", (F.col("n_nationkey") + 1).cast("long"))
    return search.lookup(search.first_chunks(hits, 6), nation)


@query(f"with {_LOOKED} select query_id, chunk_id, cast(place as int) as place, n_name, n_regionkey from looked")
def chunk_lookup(spark, d):
    return _looked(spark, d).select("query_id", "chunk_id", "place", "n_name", "n_regionkey")


@query(f"with {_LOOKED} select query_id, string_agg(n_name || chr(10) || n_regionkey, chr(10) || chr(10) order by place) as text from looked group by 1")
def chunk_text(spark, d):
    found = _looked(spark, d).withColumn("chunk", F.struct("n_name", "n_regionkey"))
    return search.chunk_text(found.withColumn("chunk_text", nested.leaf_text(F.col("chunk"), found.schema["chunk"].dataType)))


@query(f"with {_LOOKED} select query_id, chunk_id, n_name as name from looked")
def chunk_fields(spark, d):
    found = _looked(spark, d).select("query_id", "chunk_id", F.struct("n_name", "n_regionkey", "place").alias("chunk"))
    return found.select("query_id", "chunk_id", nested.by_path(found, "chunk.n_name").alias("name"))


@query(f"""{_GATE}, {_RERANKED.replace("v as (", "v as (", 1)}, keep as (select r.query_id, r.idx as chunk_id, row_number() over (partition by r.query_id order by new_rank) as place from reranked r join gate on gate.doc_id = r.idx and check_mess = '{_M["good"]}' where new_rank <= 10)
select query_id, cast(place as int) as place, chunk_id, source, lang, n_chars from keep join documents on doc_id = chunk_id where place <= 3""")
def search_end_to_end(spark, d):
    """Retrieve 20, rerank to 10, keep what passes the quality gate, and return the first 3 chunks' fields."""
    docs = table(spark, d, "documents")
    hits = _reranked(spark, d)
    asked = docs.select("doc_id", "text").join(hits.select(F.col("index").alias("doc_id")).distinct(), "doc_id", "left_semi")
    hits = hits.join(quality.quality_gate(asked).where("is_good").select(F.col("doc_id").alias("index")), "index", "left_semi")
    chosen = search.first_chunks(hits, 3, "new_rank")
    found = search.lookup(chosen, docs.withColumnRenamed("doc_id", "chunk_id"))
    return found.select("query_id", "place", "chunk_id", "source", "lang", "n_chars")


# --- summaries and evaluation

_SIM = "round(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))), 6)"


@query(f"""with e as (select vec_id, label, embedding::double[] as e from embeddings), u as (select label, unnest(range(1, len(e) + 1)) as i, unnest(e) as x from e),
m as (select label, list(a order by i) as c from (select label, i, avg(x) as a from u group by 1, 2) group by 1),
r as (select vec_id, e.label, {_SIM.format(a="e.e", b="m.c")} as s from e join m on m.label = e.label),
k as (select *, count(*) over (partition by label) as n, row_number() over (partition by label order by s desc, vec_id) as p from r)
select vec_id, label, round(s, 4) as similarity from k where n <= 3 or p <= greatest(1, floor(n * 0.4))""")
def centroid_top_ratio(spark, d):
    kept = summarize.extractive_filter(table(spark, d, "embeddings"), ["label"], "vec_id")
    return kept.select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


@query(f"""with recursive e as (select vec_id, label, embedding::double[] as e, vec_id * 37 % 200 + 20 as wc, row_number() over (partition by label order by vec_id) as i from embeddings),
s as (select a.label, a.vec_id, a.i, a.wc, coalesce({_SIM.format(a="b.e", b="a.e")}, 1.0) as sim from e a left join e b on b.label = a.label and b.i = a.i - 1),
f(label, vec_id, i, len, grp) as (select label, vec_id, i, wc, 1 from s where i = 1 union all
select s.label, s.vec_id, s.i, case when f.len + s.wc > 768 or (f.len >= 256 and s.sim < 0.7) then s.wc else f.len + s.wc end, case when f.len + s.wc > 768 or (f.len >= 256 and s.sim < 0.7) then f.grp + 1 else f.grp end from f join s on s.label = f.label and s.i = f.i + 1)
select label, vec_id, grp from f""")
def semantic_group(spark, d):
    rows = table(spark, d, "embeddings").withColumn("wc", F.col("vec_id") * 37 % 200 + 20)
    return summarize.semantic_groups(rows, ["label"], "vec_id").select("label", "vec_id", "grp")


_RTOK = "list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda w: w <> '')"


def _rouge_sql(n: int) -> str:
    gram = "array_to_string(t[i:i + {k}], ' ')".replace("{k}", str(n - 1))
    count = "(select item_id, {g} as g, count(*) as c from (select item_id, t, unnest(range(1, len(t) - {k} + 1)) as i from (select item_id, {tok} as t from pairs)) group by 1, 2)"
    pred, ref = (count.format(g=gram, k=n - 1, tok=_RTOK.format(t=c)) for c in ("prediction", "reference"))
    return f"""with pairs as (select item_id, benchmark.text as reference, documents.text as prediction from benchmark join documents on doc_id = item_id),
j as (select coalesce(p.item_id, r.item_id) as item_id, sum(least(coalesce(p.c, 0), coalesce(r.c, 0))) as m, sum(coalesce(p.c, 0)) as p, sum(coalesce(r.c, 0)) as r from {pred} p full join {ref} r on p.item_id = r.item_id and p.g = r.g group by 1)
select pairs.item_id, coalesce(round(case when p > 0 then m / p else 0 end * 100, 4), 0) as precision, coalesce(round(case when r > 0 then m / r else 0 end * 100, 4), 0) as recall, coalesce(round(case when p + r > 0 then 2 * m / (p + r) else 0 end * 100, 4), 0) as f1 from pairs left join j using (item_id)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("prediction"))
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("reference")).join(docs, "item_id")


@query(_rouge_sql(1))
def rouge1_f(spark, d):
    return evaluate.rouge_n(_pairs(spark, d), 1, ["item_id"])


@query(_rouge_sql(2))
def rouge2_f(spark, d):
    return evaluate.rouge_n(_pairs(spark, d), 2, ["item_id"])


@query()
def rouge_l(spark, d):
    return _pairs(spark, d).select("item_id", evaluate.rouge_l()("prediction", "reference").alias("f1"))


@query("select doc_id, case when cast('0x' || substr(md5('42:' || doc_id), 1, 8) as bigint) % 1000 < 900 then 'train' else 'validation' end as split from documents")
def train_split(spark, d):
    return evaluate.split_train(table(spark, d, "documents").select("doc_id"), "doc_id")


@query()
def summarize_documents(spark, d):
    from .engine import hashed_encoder

    return summarize.summarize(table(spark, d, "documents"), hashed_encoder())


#: What entry() returns.
FLAGSHIP = search_end_to_end


from . import features  # noqa: E402, F401 - registers its queries in the tables above

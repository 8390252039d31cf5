"""Edge cases, sequential models of the window forms, and plans."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions import vectors as vx
from paperloom import session
from paperloom.operators import aggregates, chunks, evaluate, index, layout, nested, paragraphs, quality, search, structure, summarize
from paperloom.plans import catalog, fixture
from paperloom.plans.engine import Engine
from paperloom.sources import readers, writers


def values(spark, column, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("x"))).collect()]


def test_roman(spark):
    assert values(spark, tx.roman_to_int, ["IV", "IX", "XL", "XC", "IIII", "", "D", "XIV"]) == [4, 9, 40, 90, 4, 0, 0, 14]
    assert values(spark, tx.is_roman, ["IV", "D", ""]) == [True, False, False]


def test_markers(spark):
    texts = ["Điều 5. abc", "Điều 5.", "C. x", "- x", "A+. y", "(a) z", "plain", "1.2.3) q", "Chương IV: t"]
    assert values(spark, tx.extract_marker, texts) == ["Điều 5. ", "Điều 5.", "C. ", "- ", "A+. ", "(a) ", None, "1.2.3) ", "Chương IV: "]
    assert values(spark, lambda c: tx.marker_type(tx.extract_marker(c)), texts) == ["Điều 123. ", "Điều 123.", "XVI. ", "- ", "ABC. ", "(abc) ", None, "123.123.123) ", "Chương XVI: "]


def test_case_style(spark):
    assert values(spark, tx.case_style, ["ABC", "Abc", "abc", "A1b", "A", "12", "Đà"]) == [3000, 2000, 1000, 1000, 3000, 1000, 2000]


def test_abbreviation(spark):
    assert values(spark, tx.is_abbreviation, ["trung", "ubnd", "", "nghiên", "gi", "anh", "xyz"]) == [False, True, True, False, True, False, True]


def test_clean(spark):
    assert values(spark, tx.clean, ["  a b @c   d ", "x–y;z!"]) == ["a b c d", "x–y;z"]


@pytest.mark.parametrize(("text", "message"), [("a" * 298, "short"), ("a" * 299, "good"), ("a" * 239 + "@" * 60, "good"), ("a" * 238 + "@" * 61, "invalid"), ("abc\n" * 100, "lines"), (None, "short")])
def test_quality(spark, text, message):
    row = quality.quality_gate(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.check_mess == quality.QUALITY_MESSAGES[message]


def test_mode_goes_to_the_first(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 1, 3, 1])], "k int, p int, v int")
    assert aggregates.mode_first_seen(rows, ["k"], "v", "p").first().v == 3


def test_global_numbers(spark):
    ids = list(range(0, 5000, 7)) * 2
    got = aggregates.global_numbers(spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "k long, n int"), ["k", "n"], "idx").orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(ids)))
    assert [(r.k, r.n) for r in got] == sorted((i, n) for n, i in enumerate(ids))


def test_gap_repair_is_the_sequential_one(spark):
    rng = random.Random(5)
    docs = {d: [rng.choice([-3, -2, -1, 0, 1, 2, 5]) for _ in range(rng.randint(1, 9))] for d in range(200)}
    rows = spark.createDataFrame([(d, i, float(v), float(v)) for d, g in docs.items() for i, v in enumerate(g)], "doc_id int, Line int, Top double, Bot double")
    got = {}
    for r in layout.repair_gaps(rows).collect():
        got[r.doc_id, r.Line] = r.Top
    for d, gaps in docs.items():
        fixed = list(gaps)
        for i, v in enumerate(gaps):
            near = ([fixed[i - 1]] if i else []) + ([gaps[i + 1]] if i + 1 < len(gaps) else [])
            if v < 0 and near:
                fixed[i] = min(near)
        assert [got[d, i] for i in range(len(gaps))] == fixed, gaps


def test_chunks_are_the_state_machines(spark):
    rng = random.Random(6)
    docs = {d: [rng.choice([None, None, 0, 1, 2]) for _ in range(rng.randint(1, 12))] for d in range(200)}
    rows = spark.createDataFrame([(d, i, v, f"t{i}") for d, g in docs.items() for i, v in enumerate(g)], "doc_id int, ln int, lvl int, txt string")
    got = {}
    for r in chunks.hierarchical_chunks(rows, 3).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((list(r.levels), list(r.content)))
    for d, seq in docs.items():
        held, body, out = ["", "", ""], [], []
        for i, level in enumerate(seq):
            if level is None:
                body.append(f"t{i}")
                continue
            if any(held[level:]) or body:
                out.append((list(held), list(body)))
            held = [*held[:level], f"t{i}", *[""] * (2 - level)]
            body = []
        out.append((held, body))
        assert got[d] == out, seq


def test_structures(spark):
    sequence = spark.createDataFrame([(1, i, m) for i, m in enumerate(["A", "B", "none", "A", "B", "none", "C", "A", "none"])], "d int, p int, m string")
    mined = {(r.depth, tuple(r.structure)): r.cnt for r in structure.build_structures(sequence, ["d"], ["p"], "m").collect()}
    assert mined[1, ("A",)] == 3 and mined[2, ("A", "B")] == 2 and mined[2, ("B", "none")] == 2
    assert (2, ("none", "A")) not in mined and (2, ("A", "none")) not in mined
    assert mined[3, ("A", "B", "none")] == 2


def _spec(spark, structures):
    """Levels of one document, from (structure, cnt)."""
    rows = spark.createDataFrame([(1, len(s), s, n) for s, n in structures], "doc_id long, depth int, structure array<string>, cnt long")
    return [(r.level_name, r.markers) for r in structure.level_specs(rows).orderBy("level_ord").collect()]


def test_level_spec(spark):
    spec = dict(_spec(spark, [(["Chương XVI", "Điều 123. ", "none"], 3), (["Điều 123. ", "123. "], 2), (["123. ", "abc) "], 2)]))
    assert list(spec)[-1] == "Content"
    assert "none" in spec["Content"]


def test_level_specs_by_hand(spark):
    abc = (["A", "B", "C"], 4)
    # nothing to add: the deepest level joins the contents, the one before is the article
    assert _spec(spark, [abc, (["A"], 9)]) == [("Article", ["A"]), ("Content", ["C", "B"])]
    assert _spec(spark, [(["A"], 9)]) == [("Content", ["A"])]
    # below B, on the level that C is beside, opened after the contents and folded into them
    assert _spec(spark, [abc, (["B", "x"], 2)]) == [("Level 1", ["A"]), ("Article", ["B"]), ("Content", ["C", "x"])]
    # two levels opened after the contents: one is left, so no level is the article
    assert _spec(spark, [abc, (["B", "x"], 2), (["B", "y", "z"], 2)]) == [("Level 1", ["A"]), ("Level 2", ["B"]), ("Level 3", ["x", "y"]), ("Content", ["C", "z"])]
    deep = (["A", "B", "C", "D", "E"], 1)
    # three: the last but one of those left
    assert _spec(spark, [deep, (["D", "w", "x", "y"], 1)]) == [("Level 1", ["A"]), ("Level 2", ["B"]), ("Level 3", ["C"]), ("Level 4", ["D"]), ("Level 6", ["x"]), ("Article", ["w"]), ("Content", ["E", "y"])]
    # below the last marker only "none"; what overlaps the top structure or begins with its first marker adds nothing
    assert _spec(spark, [abc, (["C", "none"], 1), (["C", "x"], 1), (["B", "A"], 1), (["A", "q"], 1)]) == [("Level 1", ["A"]), ("Article", ["B"]), ("Content", ["C", "none"])]
    # a tail counts once, at the lowest place
    assert _spec(spark, [deep, (["C", "t"], 1), (["B", "t"], 1)]) == [("Level 1", ["A"]), ("Level 2", ["B"]), ("Article", ["C"]), ("Content", ["E", "D", "t"])]
    # of equal top structures the first by name, by count before that
    assert _spec(spark, [(["B", "A"], 2), (["A", "B"], 2), (["C", "A"], 1)]) == [("Content", ["B", "A"])]
    assert structure.level_specs(spark.createDataFrame([], "doc_id long, depth int, structure array<string>, cnt long")).count() == 0


def test_golden_index(spark):
    """Records in the shape of a category corpus: order, keys, texts and provenance of the entries."""
    schema = "chunk_id long, Article string, Content struct<SubCategory:struct<Core:array<string>,Applied:array<string>>>"
    rows = [(1, "Toán", (((["a", "b"]), ["c"]),)), (2, "Tin", ((["b", " "], ["c", "d"]),))]
    records = spark.createDataFrame(rows, schema)
    types = nested.infer_types(records, exclude=("chunk_id",))
    assert {r.path: r.type for r in types.collect()} == {"Article": "string", "Content": "object", "Content.SubCategory": "object", "Content.SubCategory.Core": "array", "Content.SubCategory.Applied": "array"}
    got = [tuple(r) for r in index.build(records, "chunk_id", types).orderBy("index").select("index", "key", "text", "chunk_ids").collect()]
    sub = "Content.SubCategory."
    assert got == [
        (0, "Article", "Toán", [1]), (1, f"{sub}Core[0]", "a", [1]), (2, f"{sub}Core[1]", "b", [1, 2]), (3, f"{sub}Applied[0]", "c", [1, 2]),
        (4, "Article", "Tin", [2]), (5, f"{sub}Applied[1]", "d", [2]),
    ]


def test_paths_and_drops(spark):
    rows = spark.createDataFrame([(1, ([(["x"], 1), (["y", "z"], None)],))], "id int, a struct<b:array<struct<c:array<string>,d:int>>>")
    assert rows.select(nested.by_path(rows, "a.b.c")).first()[0] == ["x", "y", "z"]
    assert rows.select(nested.by_path(rows, "a.b.d")).first()[0] == [1]
    assert rows.select(nested.by_path(rows, "a.q").alias("q")).first().q is None
    assert nested.drop_columns(rows, ["C"]).select("a.b").first()[0][0].asDict() == {"d": 1}
    assert nested.merge_types(spark.createDataFrame([("p", "null"), ("p", "string"), ("q", "number"), ("q", "boolean"), ("r", "null")], "path string, type string")).orderBy("path").collect() == [("p", "string"), ("q", "mixed"), ("r", "null")]


def test_top_k(spark):
    entries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate([(1, 0), (0, 1), (1, 0), (0, 0), (-1, 0)])], "index long, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = search.top_k(asked, entries, 9).orderBy("query_id", "rank").collect()
    assert [(r["index"], r.score) for r in got if r.query_id == 7] == [(0, 1.0), (2, 1.0), (1, 0.0), (3, 0.0), (4, -1.0)]
    assert [r["index"] for r in got if r.query_id == 8] == [0, 1, 2, 3, 4]


def test_first_chunks(spark):
    hits = spark.createDataFrame([(1, 1, [5, 3]), (1, 2, [3, 9]), (1, 3, [])], "query_id int, rank int, chunk_ids array<bigint>")
    assert [r.chunk_id for r in search.first_chunks(hits, 2).orderBy("place").collect()] == [5, 3]


def test_normalize(spark):
    assert values(spark, vx.normalize, [[3.0, 4.0], [0.0, 0.0]], "array<double>") == [[0.6, 0.8], [0.0, 0.0]]


def test_rouge(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a c d"), (2, "", ""), (3, None, "x")], "k int, prediction string, reference string")
    assert [r.f1 for r in evaluate.rouge_n(pairs, 1, ["k"]).orderBy("k").collect()] == [66.6667, 0.0, 0.0]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,\n\"b\""), (2, "é")], "k int, t string")
    writers.write_csv(rows, f"{tmp_path}/c")
    assert sorted((r.k, r.t) for r in readers.read_csv(spark, f"{tmp_path}/c").collect()) == [("1", "a,\n\"b\""), ("2", "é")]
    writers.write_jsonl(rows, f"{tmp_path}/j")
    writers.write_jsonl(rows, f"{tmp_path}/j", append=True)
    assert readers.read_jsonl(spark, f"{tmp_path}/j").count() == 4
    (tmp_path / "l.jsonl").write_text('{"a": "1", "b": "2"}\n\nnot json\n{"a": "3"}\n')
    assert readers.read_jsonl_lenient(spark, f"{tmp_path}/l.jsonl", ["a", "b"]).collect() == [("1", "2")]
    (tmp_path / "r.json").write_text('{"type": "t", "items": [{"key": "x", "values": ["1", "2"]}, {"key": "y", "values": ["3"]}]}')
    assert [r.value for r in readers.read_rules(spark, f"{tmp_path}/r.json", ["x"]).orderBy("pos").collect()] == ["1", "2"]
    assert readers.exists(spark, f"{tmp_path}/r.json") and not readers.exists(spark, f"{tmp_path}/none")
    assert writers.to_jsonl_text(rows.withColumn("g", F.lit(0)), ["g"], "k").first().jsonl.count("\n") == 1
    (tmp_path / "x.PDF").write_bytes(b"abc")
    files = readers.read_uploads(spark, str(tmp_path)).select(F.lit(1).cast("long").alias("doc_id"), "content")
    parser = lambda b: iter([{"page_no": 0, "block_no": 0, "line_no": 0, "span_no": 0, "text": b.decode(), "size": 12.0, "flags": 16, "bbox": {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}}])
    lines = layout.extract(readers.parse_spans(files, parser)).collect()
    assert len(lines) == 1 and lines[0].Text == "abc" and lines[0].Style == 1100


def test_stream(spark, tmp_path):
    from paperloom.streaming.ingest import ingest

    spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2], "text": ["a fine long line of text\n" * 20, "no"]})).write.parquet(f"{tmp_path}/in")
    ingest(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]


def test_plans_hold_no_cross_join_and_one_document_shuffle(spark):
    from paperloom.plans import catalog

    plan = catalog.gap_repair(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_level_mining_reaches_every_depth(spark, monkeypatch):
    rows = [(1, p, m) for p, m in enumerate("ABCDEF" * 3)]
    monkeypatch.setattr(structure, "marker_sequence", lambda *_: spark.createDataFrame(rows, "doc_id long, pos long, marker string"))
    levels = {r.level_name: r.markers for r in catalog.level_mining(spark, "/root/testdata/sf0.001").collect()}
    assert {m for held in levels.values() for m in held} == set("ABCDEF")


def test_engine_end_to_end(spark, tmp_path):
    """Records to an index, the bundle written and read, search, answer, classification and summaries."""
    engine = Engine()
    rows = [(1, "Mathematics", ["numbers and algebra", "geometry of figures"]), (2, "Biology", ["cells and genes", "plants and animals"]), (3, "History", ["wars and treaties", "numbers and algebra"])]
    records = spark.createDataFrame(rows, "chunk_id long, Article string, Content array<string>")
    schema = engine.schema(records, ("chunk_id",))
    entries = engine.index(records, "chunk_id", schema)
    engine.save(entries, records, f"{tmp_path}/bundle")
    entries, records = engine.load(spark, f"{tmp_path}/bundle")
    assert {(r.text, tuple(r.chunk_ids)) for r in entries.collect()} >= {("numbers and algebra", (1, 3)), ("cells and genes", (2,))}
    asked = spark.createDataFrame([(7, "cells and genes"), (8, "numbers and algebra"), (9, "wars and treaties")], "query_id long, query string")
    hits = engine.search(asked, entries, 5, 3)
    best = {r.query_id: r.text for r in hits.where("new_rank = 1").collect()}
    assert best == {7: "cells and genes", 8: "numbers and algebra", 9: "wars and treaties"}
    answers = {(r.query_id, r.place): r.Article for r in engine.answer(hits, records, 2).collect()}
    assert answers[7, 1] == "Biology" and answers[8, 1] == "Mathematics" and answers[8, 2] == "History" and answers[9, 1] == "History"
    assert {r.query_id: r.labels for r in engine.classify(asked, entries, records, "Article").collect()} == {7: "Biology", 8: "Mathematics", 9: "History"}
    said = engine.summarize(spark.createDataFrame([(1, "One two three. Four five."), (2, None)], "doc_id long, text string"))
    assert {r.doc_id: r.summary_text for r in said.collect()} == {1: "One two three. Four five.", 2: ""}


def test_summary_of_long_texts(spark):
    """Sentences kept, groups and texts by plain Python, for a text that is summarised by groups."""
    import numpy as np

    rng = random.Random(5)
    sentences = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(15, 60))).capitalize() + "." for _ in range(60)]
    vectors = {s: [float(len(s) % 7 + 1), float(s.count("1") + 1), float(i % 5)] for i, s in enumerate(sentences)}
    table = F.create_map(*(x for s, v in vectors.items() for x in (F.lit(s), F.array(*map(F.lit, v)))))
    docs = spark.createDataFrame([(1, " ".join(sentences))], "doc_id long, text string")
    got = summarize.summarize(docs, lambda c: table[c], lambda t: F.substring(t, 1, 40)).first()
    v = np.array([vectors[s] for s in sentences])
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    near = np.round(unit(v) @ unit(v.mean(0)), 6)
    kept = sorted(sorted(range(60), key=lambda i: (-near[i], i))[: int(60 * 0.4)])
    groups, length = [], 0
    for k, i in enumerate(kept):
        n = len(sentences[i].split())
        same = round(float(unit(v[i]) @ unit(v[kept[k - 1]])), 6) if k else 1.0
        if not groups or length + n > 768 or (length >= 256 and same < 0.7):
            groups.append([])
            length = 0
        groups[-1].append(sentences[i])
        length += n
    assert len(groups) > 1
    assert got.summary_text == "\n".join(" ".join(g)[:40] for g in groups if len(" ".join(g).split()) >= 20)
    assert got.original_words == sum(len(s.split()) for s in sentences)


def test_semantic_groups_reset(spark):
    rows = [(k, i, w, [1.0, 0.0] if turn else [0.0, 1.0]) for k in ("a", "b") for i, (w, turn) in enumerate([(300, 0), (10, 0), (10, 1), (700, 1), (60, 1), (800, 0)])]
    got = summarize.semantic_groups(spark.createDataFrame(rows, "k string, i long, wc long, embedding array<double>"), ["k"], "i").collect()
    assert {k: [r.grp for r in sorted(got, key=lambda r: r.i) if r.k == k] for k in "ab"} == {k: [1, 1, 2, 2, 3, 4] for k in "ab"}


def test_arrow_folders_and_training_sets(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"content": ["a", None, "c"], "n": [1, 2, 3]})
    for split, new in (("train", pa.ipc.new_stream), ("validation", pa.ipc.new_file)):
        (tmp_path / "d" / split).mkdir(parents=True)
        with new(str(tmp_path / "d" / split / "data-0.arrow"), table.schema) as out:
            out.write_table(table)
    got = readers.read_training_set(spark, f"{tmp_path}/d")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((c, n, s)) for s in ("train", "validation") for c, n in (("a", 1), (None, 2), ("c", 3)))
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    assert readers.read_training_set(spark, f"{tmp_path}/x.jsonl").collect() == [(1,)]
    assert readers.read_training_set(spark, got) is got
    with pytest.raises(ValueError):
        readers.read_training_set(spark, f"{tmp_path}/none")
    with pytest.raises(TypeError):
        readers.read_training_set(spark, 5)
    assert readers.read_json(spark, f"{tmp_path}/none.json", "a int").collect() == []
    assert evaluate.training_pairs(got, "content", "split").count() == 4


def test_tokenize(spark):
    import sentencepiece

    path = "/opt/tokenizers/piece_bpe_32k.model"
    rows = spark.createDataFrame([("some words here", "short"), (None, "x " * 500)], "content string, summary string")
    got = evaluate.tokenize(rows, "content", "summary", path, "sum: ").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got[0].input_ids[: len(model.encode("sum: some words here"))] == model.encode("sum: some words here")
    assert len(got[1].labels) == 128 and len(got[1].input_ids) < 8


def test_rouge_lsum(spark):
    pairs = spark.createDataFrame([("a b c\nx y", "a c d\ny x"), ("a b c d", "a b c d"), (None, "a"), ("", "")], "p string, r string")
    # a c of the first line, one of y x of the second: 3 of 5 and 5
    assert [r.f for r in pairs.select(evaluate.rouge_lsum()("p", "r").alias("f")).collect()] == [60.0, 100.0, 0.0, 0.0]


def test_layout_options(spark):
    pages = spark.createDataFrame([(1, 2, 100.0, 100.0), (1, 1, 400.0, 300.0)], "doc_id long, page_no int, width double, height double")
    sizes = layout.page_sizes(pages)
    assert sizes.collect() == [(1, 400.0, 300.0)]
    box = "doc_id long, Line long, Coords struct<X0:double,X1:double,XM:double,Y0:double,Y1:double>"
    lines = spark.createDataFrame([(1, i, (10.0, x, 0.0, 1.0, 2.0)) for i, x in enumerate([310.0, 310.0, 200.0, 350.0])], box)
    assert layout.page_coords(lines, sizes=sizes).first().xEnd == 310.0 and layout.page_coords(lines).first().xEnd == 350.0
    romans = spark.createDataFrame([(1, i, "Mục I. ", m, f"{m}text") for i, m in enumerate(["Mục I. ", "Mục III. "])], "doc_id long, Line long, MarkerType string, MarkerText string, Text string")
    assert {r.MarkerType for r in layout.roman_run_fix(romans, replace_with="Q").collect()} == {"Mục Q. "}
    fixed = layout.roman_run_fix(romans, "text").orderBy("Line").collect()
    assert [(r.MarkerText, r.Text) for r in fixed] == [("Mục ABC. ", "Mục ABC. text")] * 2
    # of paragraphs half a percent, rounded down, is enough: one of 399
    rows = spark.createDataFrame([(1, i, "A" if i else "B", 12.0) for i in range(399)], "doc_id long, Paragraph long, MarkerType string, FontSize double")
    fonts, markers = layout.recomputed(rows)
    assert {r.MarkerType for r in markers.collect()} == {"A", "B"} and fonts.first().cnt == 399
    assert {r.MarkerType for r in layout.common_markers(rows.withColumnRenamed("Paragraph", "Line")).collect()} == {"A"}


def test_small_things(spark):
    pairs = spark.createDataFrame([("b", 3, "b[1]", " x "), ("b", 1, "b[0]", "x"), ("b", 2, "b[2]", " "), ("c", 0, "c", "x")], "base_key string, ord int, key string, text string")
    assert sorted(map(tuple, index.deduplicate_by_key(pairs).collect())) == [("b", "b[0]", "x", 1), ("c", "c", "x", 0)]
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id long, place int, chunk_text string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert dict(map(tuple, search.chunk_text(found, queries=asked).collect())) == {1: "a\n\nb", 2: "(Không có chunk nào)"}
    assert session.safely(lambda: 1 // 0, 5) == 5 and session.safely(lambda: 4, 5) == 4
    assert session.Config("x", "/r").bundle == "/r/Categories/x_Index"
    models, made = session.Models(), []
    models.register("m", lambda: made.append(1) or "model")
    assert models.get("m") == models.get("m") == "model" and made == [1]
    with pytest.raises(KeyError):
        models.get("other")
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0])], "index long, embedding array<double>")
    asked = spark.createDataFrame([(5, [1.0, 0.0]), (6, None)], "query_id long, embedding array<double>")
    assert [(r.query_id, r["index"]) for r in search.top_k(asked, odd, 3).collect()] == [(5, 0)]


def test_rouge_l_by_recursion(spark):
    from functools import cache

    rng = random.Random(6)
    texts = [(" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))), " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))) for _ in range(60)]

    def score(x, y):
        x, y = x.split(), y.split()

        @cache
        def common(i, j):
            if i == len(x) or j == len(y):
                return 0
            return 1 + common(i + 1, j + 1) if x[i] == y[j] else max(common(i + 1, j), common(i, j + 1))

        return round(200 * common(0, 0) / (len(x) + len(y)), 4) if x or y else 0.0

    got = spark.createDataFrame(texts, "a string, b string").select("a", "b", evaluate.rouge_l()("a", "b").alias("f")).collect()
    assert all(r.f == pytest.approx(score(r.a, r.b)) for r in got)


def test_level_mining_runs(spark):
    """Every document's levels end in its contents, counted from 0."""
    rows = catalog.level_mining(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.level_ord)):
        by.setdefault(r.doc_id, []).append(r)
    assert by and all(x[-1].level_name == "Content" and [r.level_ord for r in x] == list(range(len(x))) for x in by.values())


def test_paragraphs_and_markers_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "doc_id long, Paragraph int, Line int, Text string, MarkerText string, MarkerType string, Style int, FontSize double, Align string"
    # the document's common size is 10; a null size counts for nothing there
    lines = [(1, 1, 1, "a", "1. ", "123. ", 1110, 12.0, "Left"), (1, 1, 2, "b", None, None, 1010, 9.0, "Right"), (1, 2, 3, "c", "2. ", "123. ", 1000, 10.0, None), (1, 2, 4, "d", None, None, 1000, 10.0, "Center"), (1, 3, 5, "e", None, None, 1000, 10.0, None), (2, 1, 1, "f", None, None, 1000, None, "Left")]
    rows = spark.createDataFrame(lines, schema).mapInArrow(counted, schema)
    built = paragraphs.build(rows)
    assert [tuple(r) for r in built.orderBy("Paragraph").collect()] == [(1, 1, "a b", "1. ", "123. ", 1010, 9.0, "Left"), (1, 2, "c d", "2. ", "123. ", 1000, 10.0, "Center")]
    assert read.value == len(lines)
    assert [tuple(r) for r in layout.common_markers(rows, "Paragraph").collect()] == [(1, "123. ", 2, 1)]
    assert read.value == 2 * len(lines)


def test_chunks_sort_their_rows_once(spark):
    """One order for all levels; a heading without text leaves the one before in force, a higher one ends it."""
    schema = "doc_id long, ln int, lvl int, txt string"
    rows = spark.createDataFrame([(1, 1, 0, "A"), (1, 2, 1, "B"), (1, 3, 2, "C"), (1, 4, None, "x"), (1, 5, 1, None), (1, 6, None, "y"), (1, 7, 0, None), (1, 8, None, "z")], schema)
    found = chunks.hierarchical_chunks(rows, 3)
    assert [(r.levels, r.content) for r in found.orderBy("chunk").collect()] == [(["A", "B", "C"], ["x"]), (["A", "B", ""], ["y"]), (["A", "", ""], ["z"])]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Window [") - plan.count("Sort [doc_id") >= 1 and plan.count("Sort [") <= 2


def test_quality_looks_at_lines_once(spark):
    """Lines are told apart once, and each decides by its first characters; counts are those of the definition."""
    rng, white = random.Random(3), " \t\u00a0\u2003"
    breaks = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028"]
    line = lambda: rng.choice(["", " ", white]) + "".join(rng.choice("ab đ😀 \u00a0\x1f") for _ in range(rng.randint(0, 14))) + rng.choice(["", white])
    texts = ["".join(line() + rng.choice(breaks) for _ in range(60)) for _ in range(40)]
    rows = quality.quality_gate(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), quality.Limits(characters=1))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_count(") == 1
    for r in rows.collect():
        lines = [x.strip(white) for x in re.split("[" + "".join(breaks) + "]", r.text)]
        lines = [x for x in lines if x]
        assert r.short_line_ratio == pytest.approx(round(sum(len(x) < 10 for x in lines) / max(1, len(lines)), 3), abs=6e-4)


def test_index_is_worked_out_once(spark, tmp_path, monkeypatch):
    """Lines come with their document's columns without moving, and entries are written before they are numbered."""
    docs = spark.createDataFrame([(1, " a\n\n b ", "s"), (2, "b\na", None), (3, None, "s"), (4, "\n", "t")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = fixture.document_lines(spark, str(tmp_path), "source")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    both = fixture.text_lines(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ln, r.x) for r in found.collect()) == sorted(map(tuple, both)) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "a")]
    cut = []
    monkeypatch.setattr(index, "cut_lineage", lambda rows, write=index.cut_lineage: cut.append(1) or write(rows))
    assert [(r.idx, r.text) for r in catalog.dedup_provenance(spark, str(tmp_path)).orderBy("idx").collect()] == [(0, "a"), (1, "b"), (2, "b"), (3, "a")]
    assert len(cut) == 1

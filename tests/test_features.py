"""JSON types, learned sentence boundaries, stems, against plain Python and published pairs."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import session
from paperloom.functions.stemming import with_stems
from paperloom.operators import evaluate, inference, nested, sentences

# --- types of JSON


def types_by_hand(records, policy):
    seen = {}

    def kind(v):
        return "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "number"

    def merge(path, t):
        old = seen.setdefault(path, t)
        if old == "null":
            seen[path] = t
        elif t not in ("null", old):
            seen[path] = "mixed"

    def items(values, prefix):
        if values and isinstance(values[0], dict | list):
            for v in values if policy == "union" else values[:1]:
                if isinstance(v, type(values[0])):
                    (fields if isinstance(v, dict) else items)(v, prefix)

    def fields(record, prefix):
        for k, v in record.items():
            merge(prefix + k, kind(v))
            if isinstance(v, dict):
                fields(v, f"{prefix}{k}.")
            elif isinstance(v, list):
                items(v, f"{prefix}{k}.")

    for r in records:
        if isinstance(r, dict):
            fields(r, "")
    return seen


@pytest.mark.parametrize("policy", inference.POLICIES)
def test_json_types(spark, policy):
    rng = random.Random(1)

    def value(depth):
        kinds = [None, True, 3, 2.5, -1e30, "s", "", 10**25]
        if depth < 4 and rng.random() < 0.6:
            if rng.random() < 0.5:
                return {rng.choice(["a", "b", "c d", "e.f", "ü", ""]): value(depth + 1) for _ in range(rng.randint(0, 3))}
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(kinds)

    records = [value(0) for _ in range(150)] + [{}, [], None, 5, [{"a": 1}], {"deep": [[[[{"x": [1, {"y": 2}]}], [3]]], {"z": 1}]}, {"late": [None, {"q": 1}]}]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(1000, None)], "id long, j string").repartition(3)
    before = session.cuts()
    got = {r.path: r.type for r in inference.infer_json_types(rows, "j", policy).collect()}
    assert got == types_by_hand(records, policy) and len(got) > 20
    assert session.cuts() <= before + 1  # what was written on the way is gone
    assert inference.infer_json_types(rows.limit(0), "j", policy).count() == 0
    assert {r.type for r in inference.infer_json_types(spark.createDataFrame([('{"a":null}',), ("{broken",)], "j string"), "j", policy, lenient=True).collect()} == {"null"}
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        inference.infer_json_types(spark.createDataFrame([("{broken",)], "j string"), "j", policy).count()
    with pytest.raises(ValueError, match="other"):
        inference.infer_json_types(rows, "j", "other")


# --- sentences


def marked_corpus(n=300, seed=2):
    """Texts whose sentences are known: with abbreviations, names and numbers inside."""
    rng = random.Random(seed)
    nouns, verbs = "report meeting plan river street answer garden letter window price".split(), "shows takes needs brings opens keeps".split()
    short = ["Dr.", "approx.", "e.g.", "No.", "vol."]
    docs = []
    for i in range(n):
        found = []
        for _ in range(rng.randint(3, 9)):
            w = [rng.choice(["The", "A", "This", "It", "However", "Many"])]
            for _ in range(rng.randint(3, 9)):
                w.append(rng.choice(nouns + verbs))
                if rng.random() < 0.25:
                    a = rng.choice(short)
                    w += [a, rng.choice(["Miller", "Stone", "Berg"]) if a == "Dr." else rng.choice(nouns)]
            found.append(" ".join(w) + rng.choice([".", ".", ".", "!", "?"]))
        docs.append((i, found))
    return docs


def cored(w):
    return re.sub(r"^[\[({\"'“‘«]+|[\])}\"'”’»,;:.!?]+$", "", w).lower()


def likelihood(k, n, p):
    q = min(max(p, 1e-12), 1 - 1e-12)
    return k * math.log(q) + (n - k) * math.log(1 - q)


def abbreviations_by_hand(texts):
    words = [w for t in texts for w in t.split()]
    n, dots = Counter(map(cored, words)), Counter(cored(w) for w in words if re.search(r"\.[\])}\"'”’»]*$", w))
    p0, out = sum(dots.values()) / len(words), set()
    for w, d in dots.items():
        if re.search(r"[^\W\d_]", w):
            inner = w.count(".")
            size = len(w) - inner
            score = 2 * (likelihood(d, n[w], 0.99) - likelihood(d, n[w], p0)) * math.exp(-size) * (inner + 1) * size ** -(n[w] - d)
            if score >= sentences.ABBREVIATION:
                out.add(w)
    return out


def test_sentence_boundaries(spark):
    docs = marked_corpus()
    rows = spark.createDataFrame([(i, " ".join(s)) for i, s in docs], "doc_id long, text string").withColumn("core", F.lit("clash")).repartition(3)
    known = sentences.learn(rows)
    learned = {r.core for r in known.abbreviations.collect()}
    assert learned == abbreviations_by_hand([" ".join(s) for _, s in docs]) >= {"dr", "approx", "e.g", "no", "vol"}
    got = {}
    for r in sentences.split(rows, known).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    right = sum(len(set(got[i]) & set(s)) for i, s in docs)
    assert right / sum(len(s) for _, s in docs) > 0.97
    # the rule without knowledge of abbreviations cuts inside
    plain = sentences.split(rows, sentences.Boundaries(known.abbreviations.limit(0), known.openers.limit(0)))
    assert plain.count() > 1.2 * sum(len(s) for _, s in docs)


def test_sentence_boundaries_held_out(spark):
    """What some texts teach holds for others."""
    rows = lambda docs: spark.createDataFrame([(i, " ".join(s)) for i, s in docs], "doc_id long, text string")
    known = sentences.learn(rows(marked_corpus(300, 3)))
    docs = marked_corpus(80, 4)
    got = Counter((r.doc_id, r.sentence) for r in sentences.split(rows(docs), known).collect())
    wanted = Counter((i, x) for i, s in docs for x in s)
    assert sum((got & wanted).values()) > 0.97 * sum(wanted.values())


def test_sentences_of_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "..."), (5, "No end"), (6, "a. b. c."), (7, "One. " * 3000), (8, "Tab\there.\nNext one! 漢字。 And? "), (9, ".")]
    rows = spark.createDataFrame(odd, "doc_id long, text string")
    got = {}
    for r in sentences.learned_sentences(rows).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got[5] == ["No end"] and got[8] == ["Tab here.", "Next one!", "漢字。 And?"] and len(got[7]) in (1, 3000) and not {1, 2, 3, 9} & got.keys()
    assert sentences.learned_sentences(rows.limit(0)).count() == 0


def test_sentences_read_the_texts_twice(spark):
    """Once to learn from, once to split."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, "Dr. No met Mr. Yes. They spoke! Well.") for i in range(40)], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    assert sentences.learned_sentences(rows).count() >= 80
    assert read.value <= 80


# --- stems

#: Words and stems that the algorithm's author published with it.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_published_stems(spark):
    pairs = dict(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    rows = spark.createDataFrame([(w,) for w in [*pairs, "be", "I", "x1ing", "Running", "über", "", "y"]] + [(None,)], "word string").withColumn("stem", F.lit(0))
    got = {r.word: r.stem for r in with_stems(rows).collect()}
    assert {w: got[w] for w in pairs} == pairs
    assert [got[w] for w in ("be", "I", "x1ing", "Running", "über", "", "y", None)] == ["be", "i", "x1ing", "run", "über", "", "y", None]


def test_rouge_with_stems(spark):
    rows = [(1, "The cats were running quickly", "a cat runs quick"), (2, None, "x"), (3, "", ""), (4, "line one\nwalking lines", "lines ones\nwalked line")]
    pairs = spark.createDataFrame(rows, "id long, prediction string, reference string")
    stems = evaluate.stemmed(pairs, ["id"])
    by = {r.id: r for r in stems.collect()}
    assert by[1].prediction == "the cat were run quickli" and by[1].reference == "a cat run quick" and by[2].prediction == "" and by[4].prediction == "line one \n walk line"
    score = lambda rows: {r.id: r.f1 for r in evaluate.rouge_n(rows, 1, ["id"]).collect()}
    assert score(stems)[1] == pytest.approx(200 * 2 / 9, abs=1e-3) and score(pairs)[1] == 0
    longest = {r.id: r.x for r in stems.select("id", evaluate.rouge_lsum()("prediction", "reference").alias("x")).collect()}
    assert longest[4] == pytest.approx(100 * 2 * 3 / 8, abs=30) and longest[4] > 60


# --- list policy


def test_merged_lists(spark):
    from paperloom.operators import nested

    rows = spark.createDataFrame([(1, ["a ", "b"], [1.5, 2.0], [True, False], [(1, ["x", "y"])], []), (2, ["a", None], None, [], [], ["z"])], "id long, s array<string>, n array<double>, b array<boolean>, o array<struct<k:int,t:array<string>>>, e array<string>")
    got = {}
    for r in nested.flatten(rows, "id", "split", "+", merge=True).orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append((r.key, r.text))
    assert got[1] == [("s", "a +b"), ("n", "1.5+2.0"), ("b", "True+False"), ("o[0].k", "1"), ("o[0].t", "x+y"), ("e", "")]
    assert got[2] == [("s[0]", "a"), ("s[1]", None), ("b", ""), ("e", "z")]


# --- likeness of strings


def test_similar_ratio_by_recursion(spark):
    """Twice the characters in common blocks over all characters: the longest common block, then what lies left and right of it."""
    from paperloom.functions.text import similar_ratio

    def blocks(a, b):
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:  # the first of equally long ones
                    best = (n, i, j)
        n, i, j = best
        return n + blocks(a[:i], b[:j]) + blocks(a[i + n :], b[j + n :]) if n else 0

    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 14)))
    rows = [(i, text(), text()) for i in range(150)] + [(900, "", ""), (901, None, "a"), (902, "same", "same")]
    got = {r.id: r.x for r in spark.createDataFrame(rows, "id long, a string, b string").select("id", similar_ratio()("a", "b").alias("x")).collect()}
    for i, a, b in rows:
        if a is None:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(2 * blocks(a, b) / (len(a) + len(b)) if a or b else 1.0)


def test_json_types_parse_shapes_and_not_records(spark, monkeypatch):
    """Many records of few shapes are as many VARIANTs as shapes; keys that look like values, escapes and invalid records stay what they are."""
    sizes = []
    monkeypatch.setattr(inference, "cut_lineage", lambda rows, cut=inference.cut_lineage: (found := cut(rows), sizes.append(found.count()))[0])
    odd = [{"a": i, "true,1": f'x\\","b":{i}', "l": [i, {"false": -1.5e30 * i}], "5": i % 2 == 0, "n": [[1, f"s{i}"], None]} for i in range(400)]
    rows = spark.createDataFrame([(json.dumps(x),) for x in odd], "j string")
    got = {r.path: r.type for r in inference.infer_json_types(rows, "j", "union").collect()}
    assert got == {"a": "number", "true,1": "string", "l": "array", "5": "boolean", "n": "array"}
    assert sizes[0] == 1
    texts = [r.j for r in rows.limit(5).collect()] + ['{"k":"","e":[true,false],"t":"true","m":{"q:":":"}}', "3", '"s"', "null", "[1]"]
    for text, shape in zip(texts, spark.createDataFrame([(t,) for t in texts], "j string").select(inference.json_shape(F.col("j"))).collect(), strict=True):
        same = lambda v: {k: same(x) for k, x in v.items()} if isinstance(v, dict) else [same(x) for x in v] if isinstance(v, list) else None if v is None else type(v)() if isinstance(v, str) else True if isinstance(v, bool) else 0
        assert json.loads(shape[0]) == same(json.loads(text))
    # a column that can't hold nulls is checked too, and what only its shape would make valid
    for bad in ("{broken", '{"a":01}'):
        whole = spark.createDataFrame([(bad,)], T.StructType([T.StructField("j", T.StringType(), False)]))
        with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
            inference.infer_json_types(whole, "j").count()
        assert inference.infer_json_types(whole, "j", lenient=True).count() == 0


def test_flatten_of_leaves_joins_no_arrays(spark):
    """A list of plain records is one array for each record, and lists of plain values none at all."""
    rows = spark.sql("select 1 as id, array(named_struct('a', 1, 'b', 'x'), null, named_struct('a', null, 'b', 'y')) as l, array('p', null) as t, cast(null as array<string>) as n, named_struct('c', true) as s")
    found = nested.flatten(rows, "id")
    assert [tuple(r)[1:] for r in found.orderBy("ord").collect()] == [(0, "l.a", "l[0].a", "1"), (1, "l.b", "l[0].b", "x"), (2, "l.a", "l[2].a", None), (3, "l.b", "l[2].b", "y"), (4, "t", "t[0]", "p"), (5, "t", "t[1]", None), (6, "s.c", "s.c", "true")]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("flatten(") == 2  # of all fields, and of the records of the list

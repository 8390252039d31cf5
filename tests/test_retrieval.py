"""Vector search, term relevance, summaries and index upkeep against plain Python."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.operators import coverage, relevance, search, summarize, upkeep
from paperloom.plans.engine import hashed_encoder

# --- vectors


def test_top_k_of_several_lengths(spark):
    """Whatever lengths other queries and entries have, each query gets what exhaustive search gives; ties go to the smaller index."""
    rng = random.Random(1)
    vector = lambda n: [float(rng.randint(-2, 2)) for _ in range(n)]
    entries = [(i, vector(rng.choice([4, 4, 4, 5]))) for i in range(300)] + [(900, None), (901, [])]
    asked = [(q, vector(n)) for q, n in enumerate([4] * 5 + [5, 6])] + [(99, None)]
    rows = lambda x, c: spark.createDataFrame(x, f"{c} long, embedding array<double>")
    got = {}
    for r in search.top_k(rows(asked, "query_id"), rows(entries, "index").repartition(5), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["index"], r.score))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    for q, v in asked[:6]:
        exact = sorted((-round(float(unit(v) @ unit(e)), 6), i) for i, e in entries if e is not None and len(e) == len(v))[:7]
        assert [i for i, _ in got[q]] == [i for _, i in exact]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in exact], abs=1e-6)
    assert got.keys() == set(range(6))


# --- term relevance


def bm25(docs, query, k1=1.2, b=0.75):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for i, ws in words.items():
        tf, total = Counter(ws), 0.0
        for w in set(re.findall(r"[^\W_]+", (query or "").lower())):
            if tf[w]:
                total += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean))
        if any(tf[w] for w in re.findall(r"[^\W_]+", (query or "").lower())):
            out[i] = round(total, 6)
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_term_relevance(spark, block):
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(500, None), (501, ""), (502, "Éa w1! w1"), (503, "w1 " * 2000)]
    asked = [(q, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))) for q in range(12)] + [(50, "éa"), (51, "unknown"), (52, None), (53, "w1 w1 w1")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = relevance.search(spark.createDataFrame(asked, "query_id long, query string"), relevance.inverted(rows, block=block), 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for q, text in asked:
        exact = sorted(bm25(docs, text).items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in exact]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in exact], abs=2e-6)
    assert got[50] and 51 not in got and 52 not in got


def test_blocks_are_left_out(spark):
    """Upper bounds spare blocks, and the hits stay."""
    docs = spark.createDataFrame([(i, "rare rare rare" if i < 12 else "common " * 9 + ("rare" if i % 50 == 0 else "")) for i in range(2000)], "doc_id long, text string")
    index = relevance.inverted(docs, block=10)
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, query string")
    assert [r.id for r in relevance.search(asked, index, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_relevance_sends_no_row_per_posting(spark, monkeypatch):
    """Only texts, queries and each block's best move, and groups of queries find what all of them together do."""
    docs = spark.createDataFrame([(i, "common " + f"w{i % 7} " * (i % 3)) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"common w{q % 7}") for q in range(20)], "query_id long, query string")
    index = relevance.inverted(docs, block=40)
    found = relevance.search(asked, index, 4)
    assert "explode(entries" not in found._jdf.queryExecution().toString()
    rows = lambda found: sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect())
    wanted = rows(found)
    assert len(wanted) == 80
    monkeypatch.setattr(relevance, "QUERIES", 6)
    assert rows(relevance.search(asked, index, 4)) == wanted


def test_what_relevance_moves_does_not_grow_with_blocks(spark):
    """Smaller blocks send no more copies of the queries, and the hits stay."""
    docs = spark.createDataFrame([(i, f"common w{i % 7} w{i % 11} v{i % 5}") for i in range(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"common w{q % 7} v{q % 5}") for q in range(40)], "query_id long, query string")
    store, quantiles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def moved(block):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        before = {(x.stageId(), x.attemptId()) for x in stages()}
        found = sorted((r.query_id, r["rank"], r.id, r.score) for r in relevance.search(asked, relevance.inverted(docs, block=block), 3).collect())
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return found, sum(x.shuffleWriteRecords() for x in stages() if (x.stageId(), x.attemptId()) not in before)

    def stages():
        every = store.stageList(None, False, False, quantiles, None)
        return [every.apply(i) for i in range(every.size())]

    few, many = moved(400), moved(5)
    assert few[0] == many[0] and len(few[0]) == 120
    assert many[1] <= 1.2 * few[1]


def test_relevance_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "words"), (2, None), (3, "...")], "query_id long, query string")
    none = lambda rows: rows.where("false")
    found = lambda asked, docs: [(r.query_id, r.id, r["rank"]) for r in relevance.search(asked, relevance.inverted(docs), 5).collect()]
    assert found(asked, docs) == [(1, 1, 1)]
    assert found(none(asked), docs) == found(asked, none(docs)) == found(asked.where("query_id > 1"), docs) == found(asked, docs.where("doc_id > 1")) == []


# --- summaries


def test_rounds_summarise_each_group_once(spark):
    """What a round has summarised is read again, not worked out again, for the texts that are ready and for those that go on."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.str.split(".").str[0] + "."

    text = " ".join(f"Sentence {k} has some words of its own to say." for k in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    found = summarize.summarize(docs, hashed_encoder(), first)
    assert len(found.collect()) == 5 and calls.value == 5


def test_sentences_are_encoded_once(spark):
    """A round encodes each sentence of a long text once, wherever Arrow's batches cut it, and keeps texts that have no sentences."""
    calls = spark.sparkContext.accumulator(0)
    encode = hashed_encoder()

    @F.pandas_udf("string")
    def counted(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts

    rng = random.Random(9)
    sentence = lambda: " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(3, 30))).capitalize() + "."
    texts = {i: " ".join(sentence() for _ in range(rng.randint(20, 200))) for i in range(12)}
    rows = [*texts.items(), (20, "a. " * 300), (21, None), (22, "Short one. Another one here."), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    long = [t for i, t in rows if t and i != 20 and len(t.split()) >= 256]
    run = lambda: {r.doc_id: tuple(r) for r in summarize.summarize(docs, lambda c: encode(counted(c)), coverage.coverage_summary()).collect()}
    got = run()
    assert calls.value == sum(len(re.findall(r"\.", t)) for t in long) + 1  # one row of the text without sentences
    assert len(got) == len(rows) and got[20][1:3] == ("", 300) and got[21][1:3] == ("", 0) and got[22][1] == rows[-2][1] and got[None][1:] == got[0][1:]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run() == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_sentences_are_chosen_in_order():
    """Of sentences that add the same the first is taken, as if all gains were worked out by the definition."""
    rng = random.Random(7)
    for _ in range(20):
        sentences = [" ".join(f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randint(1, 9))) + "." for _ in range(25)]
        text, chosen, seen, left = coverage.Text(sentences), [], set(), 40
        while True:
            able = [i for i in range(25) if i not in chosen and text.size[i] <= left and len(set(text.runs(i))) == len(text.runs(i)) and not seen.intersection(text.runs(i))]
            rated = [(round((text.worth([*chosen, i]) - text.worth(chosen)) / text.size[i], 9), -i) for i in able]
            if not rated or (max(rated)[0] <= 1e-9 and 40 - left >= 20):
                break
            chosen.append(-max(rated)[1])
            seen.update(text.runs(chosen[-1]))
            left -= text.size[chosen[-1]]
        assert text.worth(coverage.choose(sentences, 20, 40)) >= text.worth(chosen) - 1e-6


def test_choice_against_all_choices():
    """Within the bound that the greedy rule has: (1 - 1/e) / 2 of the best choice there is."""
    rng = random.Random(3)
    for _ in range(25):
        words = [f"w{k}" for k in range(12)]
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 8))) for _ in range(8)]
        text = coverage.Text(sentences)
        best = 0.0
        for n in range(1, 5):
            for own in itertools.combinations(range(8), n):
                runs = [r for i in own for r in text.runs(i)]
                if sum(text.size[i] for i in own) <= 15 and len(set(runs)) == len(runs):
                    best = max(best, text.worth(list(own)))
        got = coverage.choose(sentences, 5, 15)
        assert sum(text.size[i] for i in got) <= 15 and text.worth(got) >= (1 - 1 / math.e) / 2 * best
        # gains fall as a choice grows
        a, b, i = [0], [0, 1, 2], 5
        assert text.worth([*a, i]) - text.worth(a) >= text.worth([*b, i]) - text.worth(b) - 1e-9


def test_summaries(spark):
    rng = random.Random(4)
    topics = [[f"{t}{k}" for k in range(15)] for t in "abcd"]
    sentences = [" ".join(rng.choice(topics[i % 4]) for _ in range(12)).capitalize() + "." for i in range(60)]
    rows = [(1, " ".join(sentences)), (2, " ".join(["Same words again and again here."] * 50)), (3, None), (4, ""), (5, "Short one. Another one here."), (6, "word " * 5000)]
    got = {r.id: r.s for r in spark.createDataFrame(rows, "id long, text string").select("id", coverage.coverage_summary()("text").alias("s")).collect()}
    size = len(got[1].split())
    assert 100 <= size <= 200
    w = re.findall(r"\w+", got[1].lower())
    assert {x[0] for x in w} == set("abcd")
    picked = [s for s in sentences if s in got[1]]
    assert " ".join(picked) == got[1]
    runs = [r for s in picked for r in zip(*(re.findall(r"\w+", s.lower())[k:] for k in range(3)), strict=False)]
    assert len(set(runs)) == len(runs)
    assert got[2] == "Same words again and again here." and got[3] == got[4] == "" and got[6] == "word word word" and got[5] == "Short one. Another one here."


# --- upkeep


def test_any_updates_equal_one_build(spark, tmp_path):
    """But for the numbers, which stay with their texts; nothing but touched partitions is written, and old texts aren't encoded again."""
    rng = random.Random(5)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(t):
        made.add(1)
        return [float(len(t)), 1.0]

    path, numbers, every = str(tmp_path / "index"), {}, 0
    for step in range(5):
        pairs = [(f"text {rng.randrange(40)}", f"b{rng.randrange(3)}", f"k{rng.randrange(5)}", rng.randrange(20)) for _ in range(0 if step == 3 else 60)] + [(None, "b", "k", 1), (" ", "b", "k", 2)]
        rows = spark.createDataFrame(pairs, "text string, base_key string, key string, chunk_id long").repartition(3)
        before = {r.text: r for r in upkeep.read(spark, path).collect()}
        encoded = made.value
        said = upkeep.update(spark, path, rows, encode, partitions=16)
        now = {r.text: r for r in upkeep.read(spark, path).collect()}
        whole = {}
        for t, b, k, c in pairs:
            if t and t.strip():
                whole.setdefault(t, []).append((c, k, b))
        assert now.keys() == whole.keys()
        for t, found in whole.items():
            c, k, b = min(found)
            assert (now[t].key, now[t].base_key, now[t].chunk_ids, now[t].embedding) == (k, b, sorted({x for x, _, _ in found}), [float(len(t)), 1.0])
        new = whole.keys() - before.keys()
        assert all(now[t]["index"] == before[t]["index"] for t in whole.keys() & before.keys())
        given = sorted(now[t]["index"] for t in new)
        assert said["new"] == len(new) == made.value - encoded and said["gone"] == len(before.keys() - whole.keys())
        assert said["kept"] + said["changed"] == len(whole.keys() & before.keys()) and said["written"] <= 16
        assert len({r["index"] for r in now.values()}) == len(now)
        if new and before:
            assert given[0] > max(r["index"] for r in before.values())
        every = max([every, *(r["index"] for r in now.values())])
    # nothing has changed: nothing is written
    again = upkeep.update(spark, path, rows, encode, partitions=16)
    assert again["written"] == again["new"] == again["gone"] == again["changed"] == 0


# --- a learned encoder


def topics(n=240, seed=6):
    """Texts of a topic share few words each, but their words occur together elsewhere."""
    rng = random.Random(seed)
    words = {t: [f"{t}{k}" for k in range(30)] for t in "abcd"}
    return [(i, t, " ".join(rng.choice(words[t]) for _ in range(6)) + " " + " ".join(f"x{rng.randrange(60)}" for _ in range(4))) for i in range(n) for t in [rng.choice("abcd")]]


def test_directions_against_numpy(spark):
    from paperloom.operators import latent

    docs = topics(150)
    rows = spark.createDataFrame([(i, t) for i, _, t in docs] + [(900, None), (901, ""), (902, "!?")], "id long, text string").repartition(4)
    found = latent.learn(rows, directions=6, cells=512, passes=12)
    a = np.zeros((len(docs), 512))
    for i, (_, _, t) in enumerate(docs):
        for c, w in latent.cells_of(t, 512).items():
            a[i, c] = w
    df = (a > 0).sum(0)
    idf = np.where(df > 0, np.log((1 + len(docs)) / (1 + df)) + 1, 0.0)
    m = a * idf
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    assert found.strength == pytest.approx(s[:6], rel=1e-3)
    own = found.projection / np.where(idf > 0, idf, 1.0)[:, None]
    assert np.allclose(own.T @ own, np.eye(6), atol=1e-6)
    # the strongest directions are the same: cosines of the angles between the spaces
    assert np.linalg.svd(vt[:4] @ own[:, :4])[1].min() > 0.99
    assert not latent.learn(rows.limit(0), directions=3, cells=64).projection.any()


def test_encoder_beats_hashes(spark):
    from paperloom.operators import latent
    from paperloom.plans.engine import hashed_encoder

    docs = topics(400, 7)
    rows = spark.createDataFrame(docs, "id long, topic string, text string").repartition(4)
    label = {i: t for i, t, _ in docs}

    def hits(encode):
        own = rows.select(F.col("id").alias("index"), encode("text").alias("embedding")).cache()
        asked = own.where("index % 8 = 0").select(F.col("index").alias("query_id"), "embedding")
        found = search.top_k(asked, own, 6).where("query_id <> index").collect()
        return np.mean([label[r.query_id] == label[r["index"]] for r in found])

    learned, plain = hits(latent.learn(rows, directions=8, cells=2048).encoder()), hits(hashed_encoder(64))
    assert learned > 0.9 and learned > plain + 0.1


def test_top_k_holds_a_part_of_the_scores(monkeypatch):
    """What a task holds doesn't grow with queries times entries, and parts give what the whole gives."""
    monkeypatch.setattr(search, "SCORE_BYTES", 1 << 20)
    rng = np.random.default_rng(8)
    asked, entries = rng.integers(-2, 3, (3000, 4)).astype(float), rng.integers(-2, 3, (4000, 4)).astype(float)
    best = search._Best(np.arange(3000), asked, 5)
    tracemalloc.start()
    for at in range(0, 4000, 1000):
        best.add(np.arange(4000)[at : at + 1000], entries[at : at + 1000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # a thousand entries' scores alone are 24 MB
    for q in range(0, 3000, 37):
        score = np.round(asked[q] @ entries.T, 6)
        first = np.lexsort((np.arange(4000), -score))[:5]
        assert best.entry[q].tolist() == first.tolist() and best.score[q].tolist() == score[first].tolist()
    few = search._Best(np.arange(2), asked[:2], 5)
    few.add(np.arange(3), np.array([[1.0, 0, 0, 0], [np.nan, 0, 0, 0], [0, 1.0, 0, 0]]))
    assert few.rows().column("index").to_pylist() and 1 not in few.rows().column("index").to_pylist() and few.rows().num_rows == 4

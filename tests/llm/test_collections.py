"""Phrases, quality and the manifest against plain Python on small tables, with nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import merkle, phrases, quality
from paperloom.llm.textkernel import utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- phrases


def phrases_by_hand(rows, support, longest=4, most=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        drop = {p[i:j] for p, d in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * d >= 80 * counts[p[i:j]]}
        found = []
        for p, a in cand.items():
            if p not in drop:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def texts_with_phrases(seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "ß", "漢字", "new", "york", "city", "rare", "x y", "Ab"]
    rows = []
    for i in range(160):
        w = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", " \t", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(w) + rng.choice(["", " New York City Hall"]), rng.choice(["en", "en", "en", "de", None, "und"]), None, None))
    odd = [None, "", " \t ", ".,;", "the", "the the the the the the " * 40, "of the of the. " * 300, "a" * 9000]
    return rows + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(odd)] + [(None, "new york " * 50, None, None, None)] * 3


@pytest.mark.parametrize("block, share, cells", [(1 << 20, 1 << 14, None), (300, 20, 2), (1000, 1, 64)])
def test_phrases(spark, nothing, block, share, cells, monkeypatch):
    """Blocks, dealt pivots and a table too small for the words change no count."""
    rows = texts_with_phrases()
    fragments, rarity, count, pairs = phrases.fragments, phrases.rarity, phrases.count_words, phrases.pair_filter
    monkeypatch.setattr(phrases, "fragments", lambda *a: fragments(*a, limit=block, share=share))
    monkeypatch.setattr(phrases, "rarity", lambda words: rarity(words, cells))
    monkeypatch.setattr(phrases, "count_words", lambda texts: count(texts, block))
    monkeypatch.setattr(phrases, "pair_filter", lambda *a: pairs(*a, limit=block))
    if cells:  # and so do pairs that share cells
        monkeypatch.setattr(phrases, "_LEAST_PAIRS", cells * 8)
        monkeypatch.setattr(phrases, "_MOST_PAIRS", cells * 8)
    docs = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    for support in (5, 30):
        got = sorted(map(tuple, phrases.collocations(docs, support).collect()))
        assert got == phrases_by_hand([(r[1], r[2]) for r in rows], support)
        assert len(got) > 5
    assert phrases.collocations(nothing).count() == 0


def test_phrases_limit(spark):
    rows = texts_with_phrases(2)
    got = sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, DOCS), 3, most=7).collect()))
    assert got == phrases_by_hand([(r[1], r[2]) for r in rows], 3, most=7)


def test_phrases_score_is_exact(spark):
    """Products beyond 64 bits."""
    big = 9 * 10**18
    row = spark.createDataFrame([(big, big, big - 1)], "a long, l long, r long")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    assert row.select(score.alias("s")).first().s == 2000000 * big // (2 * big - 1)


def test_words_with_equal_hashes(monkeypatch):
    """Words are told apart by their bytes where hashes don't."""
    monkeypatch.setattr(phrases, "xxh64", lambda data, start, end, seed=42: (end - start).astype(np.uint64))
    data, offsets = utf8(pa.array(["ab cd ab efg", "cd ab"]))
    block = phrases.Block(data, offsets, np.array([0, 1]), np.zeros(2, np.uint64))
    assert len({(int(c), int(g)) for c, g in zip(block.code, block.lang, strict=True)}) == len(set(block.code.tolist())) == 5


# --- quality


def documents_of_quality(n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        text = " ".join(w) + "." if good else rng.choice([" ".join(x + "$$$" for x in w), " ".join(w[:3] * 20), " ".join(w).upper() + "!!"])
        docs.append((i, text, "en", "s", None))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality(spark, nothing):
    docs, labels = documents_of_quality()
    odd = [(2000, None), (2001, ""), (2002, " \n"), (2003, "word " * 20000), (2004, "ä"), (None, "lost id"), (5, docs[5][1])]
    rows = spark.createDataFrame([*docs, *((i, t, None, None, None) for i, t in odd)], DOCS).withColumn("score", F.lit("clash")).withColumn("stats", F.lit(1)).repartition(5)
    marks = spark.createDataFrame([*labels, (2000, None, 1), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.predict(rows, marks).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    truth = dict((i, y) for i, y, _ in labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    # labels of held-out rows have no influence
    turned = marks.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((r.doc_id or -1, r.score) for r in quality.predict(rows, turned).collect()) == sorted((r.doc_id or -1, r.score) for r in got)
    assert quality.predict(nothing, marks).count() == 0
    assert {r.score for r in quality.predict(rows, marks.limit(0)).collect()} == {0.5}


def test_quality_by_plain_numpy(spark):
    """The summed equations give the weights that least squares on all rows at once gives, and scores follow from them."""
    docs, labels = documents_of_quality(400, 4)
    rows = spark.createDataFrame(docs, DOCS).repartition(7)
    stats = quality.with_statistics(rows)
    model = quality.train(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), features=32)
    use = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    x = quality.statistics(*utf8(pa.array([docs[i][1] for i in use]))).astype(np.float32).astype(float)
    y = np.array([labels[i][1] for i in use], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-3), atol=1e-6)
    a = model.expand(x)
    penalised = np.diag([1.0] * 32 + [0.0])
    errors = [np.abs(np.linalg.solve(a.T @ a + p * len(a) * penalised, a.T @ y) - model.weights[:, 0]).max() for p in quality.PENALTIES]
    assert min(errors) < 1e-6
    scores = {r.doc_id: r.score for r in quality.scored(stats, model).collect()}
    raw = a @ model.weights[:, 0]
    assert np.allclose([scores[i] for i in use], np.clip(np.interp(raw, *model.curve), 0, 1), atol=1e-6)


def test_random_features_are_a_gaussian_kernel():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    model = quality.Model(np.zeros(6), np.ones(6), features=20000, width=0.8)
    z = model.expand(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 0.8**2 * 6))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_isotonic():
    rng = random.Random(6)
    for _ in range(50):
        n = np.array([rng.randint(1, 5) for _ in range(12)])
        ones = np.array([rng.randint(0, int(k)) for k in n])
        x, p = quality.isotonic(np.arange(12.0), ones, n)
        assert (np.diff(p) > 0).all() and (np.diff(x) > 0).all()
        # least squares under monotony: the greatest mean from below of the least mean from above
        share = lambda i, j: ones[i : j + 1].sum() / n[i : j + 1].sum()  # noqa: B023, E731
        exact = [max(min(share(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert np.allclose(sorted(set(np.round(exact, 9))), p)


def test_statistics_by_plain_python():
    texts = [None, "", "One one TWO!! | $$$ a1.\nOne one TWO!!\n\nlast line", "é É漢 x", "word " * 50]
    got = quality.statistics(*utf8(pa.array(texts)))
    assert np.isfinite(got).all() and not got[1, [0, 1, 9]].any()
    for t, row in zip(texts, got, strict=True):
        by = dict(zip(quality.STATISTICS, row, strict=True))
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in re.split("[\n-\r]", t or "") if x]
        n = max(len(w), 1)
        assert np.isclose(by["log_chars"], np.log1p(len(t or ""))) and np.isclose(by["log_words"], np.log1p(len(w)))
        assert np.isclose(by["distinct_words"], len(set(w)) / n) and np.isclose(by["top_word"] ** 2, max(collections.Counter(w).values(), default=0) / n)
        assert np.isclose(by["repeated_next"] ** 2, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n)
        assert np.isclose(by["exclaimed_words"] ** 2, sum(x[-1] in "!?" for x in w) / n)
        assert np.isclose(by["log_lines"], np.log1p(len(lines))) and np.isclose(by["repeated_lines"] ** 2, 1 - len(set(lines)) / max(len(lines), 1))
        assert np.isclose(by["bare_words"] ** 2, sum(not re.search(r"[A-Za-z0-9]|[^\x00-\x7f]", x) for x in w) / n)


# --- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes, arity):
    """The root, and for each leaf what stands left and right of its path, from below."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // arity * arity :][:arity]
            paths[k].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [p // arity for p in at]
    return nodes[0], paths


def manifest_by_hand(rows, arity=2):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))) for g in langs}
    found = {g: tree([leaf(r) for r in trees[g]], arity) for g in langs}
    root, upper = tree([found[g][0] for g in langs], arity)
    out = []
    for g, above in zip(langs, upper, strict=True):
        for r, path in zip(trees[g], found[g][1], strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4] + 1)) if changed else leaf(r)
            for left, right in path + above:
                node = digest(left, node, right)
            out.append((r[0], leaf(r), found[g][0], root, digest(*(a + b for a, b in path + above)), node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest(spark, nothing, arity):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "", "é 漢字", "text " * rng.randint(1, 9)]), rng.choice(["en"] * 8 + [None, "", "de", "é", "z"]), rng.choice([None, "s:1"]), rng.choice([None, 0, 99])) for i in range(120)]
    rows += [(-5, "x" * 50000, "en", None, 3), (None, "no id", "en", None, 1), (None, "no id", "fr", None, 1), (7, "tie a", "en", None, 1), *[rows[3]] * 5]
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit(1)).withColumn("pos", F.lit(2)).repartition(4)
    got = merkle.prove_documents(docs, arity)
    assert got.columns == COLUMNS
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(manifest_by_hand(rows, arity))
    one = rows[:1]
    assert [tuple(r) for r in merkle.prove_documents(spark.createDataFrame(one, DOCS), arity).collect()] == manifest_by_hand(one, arity)
    assert merkle.prove_documents(nothing, arity).count() == 0


def test_manifest_finds_changes(spark):
    rows = [(i, f"text {i}", "en", None, 6) for i in range(33)]
    docs = spark.createDataFrame(rows, DOCS)
    values = [F.col(c) for c in merkle.FIELDS]
    tree_of = lambda df: merkle.manifest(df, merkle.leaf_digest(values), F.col("lang"), F.col("doc_id"), [F.col("doc_id")])
    first, again, other = tree_of(docs), tree_of(docs.repartition(5)), tree_of(docs.replace("text 9", "text 8"))
    assert first.root == again.root != other.root
    assert first.rows.where(merkle.folded(F.col("leaf"), F.col("proof")) != first.root).count() == 0
    assert first.rows.where(merkle.folded(F.col("leaf"), F.col("proof")) == other.root).count() == 0

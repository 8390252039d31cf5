"""Each operator against plain Python on small tables, with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns."""

import base64
import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import chat, components, decontaminate, htmltext, langid, lm, minhash, mixing, ordered, simhash, textkernel, toxicity, warc
from paperloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text, n):
    w = words(text)
    return [" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))] if w else []


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "one two"), (6, "é ß 漢字 x"), (6, "é ß 漢字 x"), (7, "a" * 5000), (8, "w " * 3000), (None, "lost id and text"), (9, "Punct, uation!! 123")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, t, None, None, None) for i, t in ODD]
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(60)) for _ in range(30)]
    for k, t in enumerate(base):
        rows.append((100 + 2 * k, t, "en", f"s{k % 4}", len(t)))
        w = t.split()
        w[rng.randrange(60)] = "changed"
        rows.append((101 + 2 * k, t if k % 3 == 0 else " ".join(w), "en", None, len(t)))
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("a clashing name")).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_xxh64_and_words():
    rng = random.Random(2)
    texts = [None, "", "x" * 3000 + " y z"] + ["".join(rng.choice("ab cdé\n\t ABC.ß  ") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    hashes, begin = textkernel.shingle_hashes(*textkernel.utf8(pa.array(texts)), 3)
    for t, i, j in zip(texts, begin, begin[1:], strict=False):
        assert list(hashes[i:j]) == [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(t, 3)]


def test_slices_are_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c"])], ["text"])
    assert [s.num_rows for s in textkernel.slices(batch, "text", 20)] == [2, 1, 1]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame([*edges, (5, 5), (None, 3)], "u long, v long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


# --- 1


def test_minhash_query(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_BYTES", 2000)
    got = minhash.fingerprint_with_edits(docs).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    wanted = collections.Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        wanted[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == wanted
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, r.near_next)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert minhash.fingerprint_with_edits(nothing).count() == 0
    one = minhash.fingerprint_with_edits(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_minhash_estimates():
    rng = random.Random(4)
    hasher, errors = minhash.MinHash(), []
    for _ in range(60):
        a = [str(rng.random()) for _ in range(300)]
        b = a[: rng.randint(50, 300)] + [str(rng.random()) for _ in range(50)]
        x, y = " ".join(a), " ".join(b)
        s = hasher.signatures(*textkernel.utf8(pa.array([x, y])))
        p, q = set(shingles(x, 5)), set(shingles(y, 5))
        errors.append(minhash.likeness(s[:1], s[1:])[0] - len(p & q) / len(p | q))
    assert np.std(errors) < 0.06 and abs(np.mean(errors)) < 0.02


def test_minhash_near_duplicates(spark, docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in minhash.near_duplicates(docs, 0.8).collect()}
    by = {r.doc_id: set(shingles(r.text, 5)) for r in docs.collect() if r.doc_id is not None}
    found = {i: c for (i, _), c in got.items() if i is not None}
    for i in by:
        same = [j for j in by if (not by[i] and not by[j]) or (by[i] | by[j] and len(by[i] & by[j]) >= 0.8 * len(by[i] | by[j]))]
        assert found[i] == min(found[j] for j in same) <= min(same), i


@pytest.mark.parametrize("block", [None, 40])
def test_minhash_large_buckets(spark, nothing, block, monkeypatch):
    """Hundreds of different near copies, and chains of versions, are connected as their similarities say."""
    if block:
        monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(14)
    base, texts = [f"w{rng.randrange(3000)}" for _ in range(300)], {}
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(300), rng.randint(1, 6)):
            w[at] = f"e{rng.randrange(10**6)}"
        texts[k] = " ".join(w)
    w = [f"v{rng.randrange(3000)}" for _ in range(300)]
    for k in range(120):
        w[rng.randrange(300)] = f"f{rng.randrange(10**6)}"
        texts[1000 + k] = " ".join(w)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS)).collect()}
    sets, root = {i: set(shingles(t, 5)) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in texts}
    assert minhash.near_duplicates(nothing).count() == 0


# --- 2


@pytest.mark.parametrize("limit", [None, 0])
def test_lm(spark, docs, nothing, limit):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    rows = [(r.doc_id, [*words(r.text), None]) for r in docs.collect()]
    count = collections.Counter(t for i, w in rows if not held(i) for t in w)
    pair = collections.Counter(p for i, w in rows if not held(i) for p in itertools.pairwise(["<", *w]))
    n, v = sum(count.values()), len(count)
    base = lambda t: (count[t] + 1) / (n + v + 1)
    # contexts' frequencies to a factor of 2, those that share a cell with a rarer one taken for it
    place = lambda t: int(lm.Contexts.place(np.array([lm.END if t is None else xxhash.xxh64_intdigest(t.encode(), 42)], np.uint64), 1 << 16)[0])
    cell = {}
    for t, c in count.items():
        cell[place(t)] = min(cell.get(place(t), 99), int(math.log2(c)))

    def spare_of(t):
        c = 2.0 ** cell.get(place(t), 0)
        shown = 1 + (1 / 64) / (1 - 2 / 64)  # what a false positive shows on average
        h = min(max(math.ceil(math.log2(v / (math.sqrt(4 + 0.2 * c / shown) - 2) ** 2)), 2), 48)
        return shown * (v / 2**h + 4 * (v / 2**h) ** 0.5)

    def probability(u, t):
        c = count[None] if u == "<" else count[u]
        seen = 2 ** int(math.log2(pair[u, t])) if pair[u, t] else 0
        mass = lm.MASS * max(c, 1) ** lm.POWER
        # what the filter's false positives add is taken off
        spare = 0 if limit == 0 else spare_of(None if u == "<" else u)
        trust = c / (c + spare) if c else 0
        return (trust * seen + mass * base(t)) / (c + mass)

    wanted = sorted((str(i), held(i), len(w), sum(count[t] > 0 for t in w), n, sum(math.log10(base(t)) for t in w), sum(math.log10(probability(*p)) for p in itertools.pairwise(["<", *w]))) for i, w in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_documents(docs, limit).collect())
    for a, b in zip(got, wanted, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
        # the filter's false positives can only raise a count
        assert a[6] >= b[6] - 1e-9 if limit is None else a[6] == pytest.approx(b[6])
    assert sum(a[6] for a in got) == pytest.approx(sum(b[6] for b in wanted), rel=0.01)
    assert lm.score_documents(nothing, limit).count() == 0


@pytest.mark.parametrize("shard_bytes", [lm.SHARD_BYTES, 2000])
def test_lm_scores_do_not_depend_on_size(spark, docs, nothing, monkeypatch, shard_bytes):
    """A model that is too large to broadcast gives the scores of one that isn't, false positives included."""
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    extra = [(2000 + i, " ".join(f"u{(i * 7 + k * k) % 301}" for k in range(80)), None, None, None) for i in range(60)]
    both = docs.drop("score").unionByName(spark.createDataFrame(extra, DOCS))
    wanted, got = (sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_documents(both, limit).collect()) for limit in (None, 1))
    model, some = lm.train(both), np.random.default_rng(4).integers(0, 2**63, 200000).astype(np.uint64)
    assert (model.pair_level(some, np.full(len(some), model.contexts.functions(np.array([lm.START]))[0])) > 0).any()
    for a, b in zip(got, wanted, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    assert lm.score_documents(nothing, 1).count() == 0


def test_lm_is_broadcast_in_pieces(spark, docs, monkeypatch):
    """The driver holds some shards at a time, and pieces score as the whole does."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    rows = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score_documents(docs).collect())
    whole = rows()
    monkeypatch.setattr(lm, "PIECE_BYTES", 4000)
    parts = lm.trained(docs.where(~lm.held_out()))
    pieces, model = [p.value for p in lm.broadcast_pieces(parts)], lm.gathered(parts)
    assert len(pieces) > 1 and [p.first for p in pieces] == np.cumsum([0, *(len(p.starts) for p in pieces[:-1])]).tolist()
    size = [len(p.token_keys) + 2 * len(p.token_counts) + len(p.filters) + len(p.raised_keys) + len(p.raised_levels) for p in pieces]
    assert all(n <= 4000 or len(p.starts) == 1 for n, p in zip(size, pieces, strict=True))
    assert b"".join(p.filters for p in pieces) == bytes(model.filters)
    assert rows() == whole
    assert lm.broadcast_pieces(parts, 1) is None


def test_lm_writes_no_row_per_pair(spark, docs, monkeypatch):
    """A model that isn't broadcast is asked in binaries: only its own tables are written, and many small runs score as one."""
    tables = []
    monkeypatch.setattr(lm, "written", lambda rows, name, write=lm.written: tables.append(name) or write(rows, name))
    rows = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score_documents(docs, 1).collect())
    one = rows()
    assert set(tables) == {"lm-tokens", "lm-filters"}
    monkeypatch.setattr(lm, "RUN_BYTES", 500)
    assert rows() == one


def test_lm_filter_has_no_false_negative():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.integers(1, 200, len(keys))
    tests = rng.integers(2, 30, len(keys))
    filter_, raised, raised_levels = lm.build_filter(keys, counts, tests)
    assert (lm.Model(0, 0, b"", b"", filter_, [0]).pair_level(keys, tests) >= lm.levels(counts)).all() and len(raised)
    model = lm.Model(0, 0, b"", b"", filter_, [0], None, raised, raised_levels)
    assert (model.pair_level(keys, tests) == lm.levels(counts)).all()  # what was seen has its own level
    other = rng.integers(0, 2**63, 40000).astype(np.uint64)
    for h in (2, 5, 9):  # half of the bits are set
        assert (model.pair_level(other, np.full(len(other), h)) > 0).mean() == pytest.approx(2.0**-h, rel=0.35)


def test_lm_probabilities_sum_to_one_at_most(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.train(docs)
    token, before, _ = lm.tokens(*textkernel.utf8(docs.select("text").toArrow().column("text")))
    every = np.append(np.unique(token), np.uint64(12345))  # and one that was never seen
    assert model.distinct == len(every) - 1 and model.total == len(token)
    rng = np.random.default_rng(3)
    count = model.token_count(every)
    base = (count + 1) / (model.total + model.distinct + 1)
    assert base.sum() == pytest.approx(1)
    sums = []
    for u in [*rng.choice(np.unique(before), 60), lm.START]:
        c = model.token_count(np.array([lm.END if u == lm.START else u]))[0]
        tests = model.contexts.functions(np.full(len(every), u, np.uint64))
        level = model.pair_level(lm.pairs(np.full(len(every), u), every), tests)
        mass = lm.MASS * max(c, 1) ** lm.POWER
        trust = c / (c + lm.false_mass(model.distinct, tests[0]))
        sums.append(((trust * np.minimum(np.where(level > 0, 2.0 ** (level - 1), 0), c) + mass * base) / (c + mass)).sum())
    assert max(sums) <= 1 + 1e-9 and min(sums) > 0.6
    # it predicts better than token counts alone, on texts that it hasn't seen too
    rows = lm.score_documents(docs).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert rows.a > rows.b


def test_lm_keeps_what_counts_know(spark):
    """Of what exact pair counts gain on texts that weren't seen, the filter keeps nine tenths or more; and no context has
    more than a share of its count in false followers, however many tokens there are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [lm.score_documents(docs, limit).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first() for limit in (None, 0)]
    gain = [r.s - r.b for r in sums]
    assert gain[0] >= 0.9 * gain[1] > 0
    for distinct in (10**3, 10**6, 10**9):
        frequency = np.arange(20)
        assert (lm.false_mass(distinct, lm.functions(frequency, distinct)) <= lm.SPARE * 2.0**frequency * 1.0001).all()


# --- 3


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "c", ""), (None, "d", ""), (5, "e", "WARC/1.1\r\n\r\n\r\n x"), (5, "e", "WARC/1.1\r\n\r\n\r\n x"), (6, "f", "z" * 200000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, record_type int")
    duck = duckdb.connect()
    duck.register("pages", pages.select("page_id", "url", "html").toArrow())
    got = warc.round_trip(pages)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duck.sql(oracle_sql()["op3_warc"]).fetchall()))
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    some = warc.read_warc(spark, path, payload="full").where("record_type = 'response' and target_uri = 'f'").collect()
    assert [bytes(r.payload) for r in some] == [b"z" * 200000]
    assert some[0].payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(b"z" * 200000).digest()).decode()
    assert warc.read_warc(spark, path).where("record_type = 'revisit'").count() == 3
    file = tmp_path / "x.warc.gz"
    import gzip

    file.write_bytes(b"".join(gzip.compress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")) if p.stat().st_size))
    assert warc.read_warc(spark, f"file://{file}").count() == len(rows)


def test_warc_detects_damage(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="isn't what its digest says"):
        warc.read_warc(spark, f"file://{tmp_path}", verify=True).collect()
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="doesn't say how long"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()


# --- 4


def test_mixing(spark, docs, nothing):
    got = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.target, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    source = collections.Counter()
    for r in docs.collect():
        source[r.source] += len(words(r.text))
    order = sorted(source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(source.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        unit = (total - sum(3 * source[s] for s in stopped)) / sum(weight[s] for s in free) if free else 0
        new = [s for s in free if unit * weight[s] > 3 * source[s]]
        if not new:
            break
        stopped |= set(new)
    target = {s: 3.0 * source[s] if s in stopped else unit * weight[s] for s in order}
    assert collections.Counter(round(r.target, 6) for r in got).keys() == {round(t, 6) for t in target.values()}
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    of = {r.doc_id: r.source for r in docs.collect()}
    for s in order:
        mine = [r for r in got if of[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
    assert mixing.mix_documents(nothing).count() == 0
    assert mixing.mixture(docs).columns == [*docs.columns, "size", "source_size", "target", "taken", "copies"]


def test_mixing_choice(spark):
    """Which documents the mix takes, by Pareto ranks worked out in plain Python; shorter ones are likelier."""
    rng = random.Random(31)
    rows = [(i, f"s{i % 3}", rng.choice([1, 5, 20, 100, 400])) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    hashes = {r.doc_id: r.h & (2**64 - 1) for r in sizes.select("doc_id", F.xxhash64("doc_id", F.lit(42)).alias("h")).collect()}
    goals = [("s0", 0.3), ("s1", 1.0), ("s2", 2.6)]
    total = {s: sum(z for _, t, z in rows if t == s) for s, _ in goals}
    table = spark.createDataFrame([(s, total[s], f * total[s]) for s, f in goals], "source string, source_size long, target double")
    got = {r.doc_id: r.taken for r in mixing.mix(sizes, table).collect()}
    for s, f in goals:
        mine = [(i, z) for i, t, z in rows if t == s]
        whole = math.floor(f + 1e-12)
        rest = (f - whole) * total[s]
        expected = sum(z**0.5 for _, z in mine)

        def rank(i, z, rest=rest, expected=expected):
            share = min(max(z**-0.5 * rest / expected, 1e-12), 1 - 1e-12)
            u = ((hashes[i] >> 11) + 0.5) / 2**53
            q = u / (1 - u) / (share / (1 - share))
            return q / (1 + q)

        more, left = set(), rest
        for i, z in sorted(mine, key=lambda x: rank(*x)):
            if z > left:
                break
            more.add(i)
            left -= z
        extra = [i for i, z in mine if got[i] != z * (whole + (i in more))]
        # besides those in order, one document at most, the one that fills the rest best
        assert len(extra) <= 1 and all(i not in more and abs(left - dict(mine)[i]) < left for i in extra)
        if 0 < rest:
            share = lambda z: np.mean([i in more for i, y in mine if y == z])
            assert share(1) > share(100) > 0


def test_mixing_odds(spark):
    sizes = spark.range(4000).selectExpr("id as doc_id", "'s' as source", "1L as size", "case when id % 2 = 0 then 9.0 else 1.0 end as w")
    goals = spark.createDataFrame([("s", 4000, 2000.0)], "source string, source_size long, target double")
    got = mixing.mix(sizes, goals, odds="w").where("taken > 0").collect()
    assert abs(len(got) - 2000) <= 1 and sum(r.doc_id % 2 == 0 for r in got) > 1300


# --- 5


def plain_simhash(text, n=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [None, 3])
def test_simhash(spark, docs, nothing, bucket):
    rng = random.Random(7)
    extra = [(1000 + i, " ".join(f"t{rng.randrange(3)}" for _ in range(rng.randint(1, 6))), None, None, None) for i in range(120)]
    both = docs.drop("score").unionByName(spark.createDataFrame(extra, DOCS))
    rows = [(r.doc_id, plain_simhash(r.text)) for r in both.collect()]
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    wanted = sorted(str((i, f"{p:016x}", least.get(find(p)))) for i, p in rows)
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(both, bucket=bucket).collect()) == wanted
    assert simhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_spare_the_driver(spark, monkeypatch):
    """Rounds of small tables are joined where they lie; the driver collects none of them to send it to all tasks."""
    edges = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (9, 7), (8, 7)], "u long, v long")
    got = components._small_star(components._large_star(edges).distinct()).distinct()
    assert sorted(map(tuple, got.collect())) == [(2, 1), (3, 1), (4, 2), (8, 7), (9, 7)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    names, put = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: names.append(name) or put(df, name))
    rest = spark.createDataFrame([(1, 1, [1, 2, 3], 67), (2, 1, [1, 2, 3], 67), (3, 1, [7, 8], 66), (5, 4, [], 64)], "doc_id long, root long, shingles array<long>, n long")
    assert [r.doc_id for r in simhash._repeats(rest).collect()] == [2]
    assert names == ["large"]  # no group is large, so no rounds


def test_driver_gives_back_training_memory(spark, docs, monkeypatch):
    given = []
    for module in (toxicity, langid):
        monkeypatch.setattr(module, "tidy", lambda m=module: given.append(m), raising=False)
    toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    langid.train(docs.withColumn("lang", F.lit("en")))
    assert given == [toxicity, langid]


def test_keep_first(spark, docs):
    """Copies and near copies go, the least doc_id stays, and nothing else goes."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(500)}" for _ in range(200)] for _ in range(12)]
    rows = []
    for k, w in enumerate(base):
        rows.append((10 * k + 2000, " ".join(w), None, None, None))
        for c in range(1, 4):
            other = list(w)
            other[rng.randrange(200)] = "edited"
            rows.append((10 * k + 2000 + c, " ".join(other if c < 3 else w), None, None, None))
    rows += [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "", None, None, None), (None, " ".join(base[0]), None, None, None), (None, " ".join(base[0]), None, None, None)]
    kept = [r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [10 * k + 2000 for k in range(12)] + [5000, None, None]))
    assert simhash.keep_first(docs).columns == docs.columns


def first_kept(texts):
    """Ids that stay if, in order, each goes that is 0.8 alike to one that stays; by plain sets."""
    seen, left = {i: set(shingles(t, 5)) for i, t in texts.items()}, []
    for i in sorted(texts):
        if not any(len(seen[i] & seen[j]) >= 0.8 * len(seen[i] | seen[j]) for j in left):
            left.append(i)
    return left


@pytest.mark.parametrize("group", [None, 6000])
def test_keep_first_of_large_groups(spark, group, monkeypatch):
    """Hundreds of edited copies, and successive versions, leave no two that are 0.8 alike."""
    rng = random.Random(12)
    if group:
        monkeypatch.setattr(simhash, "GROUP", group)
    base, texts = [f"w{rng.randrange(3000)}" for _ in range(400)], {}
    for k in range(200):
        w = list(base)
        for at in rng.sample(range(400), 5):
            w[at] = f"e{rng.randrange(10**6)}"
        texts[k] = " ".join(w)
    w = [f"v{rng.randrange(3000)}" for _ in range(400)]
    for k in range(150):
        w[rng.randrange(400)] = f"f{rng.randrange(10**6)}"
        texts[1000 + k] = " ".join(w)
    rows = [(i, t, None, None, None) for i, t in texts.items()]
    rng.shuffle(rows)
    kept = sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == first_kept(texts) and 20 < len(kept) < 150


def test_keep_first_finds_block_edits(spark):
    """Copies with one replaced block, 0.80 to 0.92 alike, go."""
    rng = random.Random(13)
    texts = {}
    for k in range(150):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 800))]
        texts[10 * k] = " ".join(w)
        for c in range(1, 3):
            n = int(len(w) * rng.uniform(0.04, 0.105))
            at = rng.randrange(len(w) - n)
            texts[10 * k + c] = " ".join([*w[:at], *(f"b{rng.randrange(10**6)}" for _ in range(n)), *w[at + n :]])
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS)).collect()}
    wanted = set(first_kept(texts))
    assert wanted <= kept and len(kept - wanted) <= 1


def test_simhash_general_limits(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 7))) for b in base for _ in range(5)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for limit in (1, 4, 6):
        got = {frozenset((r.u, r.v)) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), limit).collect()}
        root = components.connected_components(spark.createDataFrame([tuple(g) for g in got], "u long, v long")).collect()
        root = {r.node: r.root for r in root}
        for a, b in itertools.combinations(range(len(prints)), 2):
            if 0 < (prints[a] ^ prints[b]).bit_count() <= limit:
                assert root[signed[a]] == root[signed[b]]


def test_allocation():
    cost = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 10.0}, {-1: 0.0, 0: 9.0, 1: 90.0}]
    for total in (-2, -1, 0, 1, 2):
        least, chosen = simhash.allocate(cost, total)
        assert sum(chosen) == total and least == sum(cost[i][t] for i, t in enumerate(chosen))
        assert least == min(sum(cost[i][t] for i, t in enumerate(c)) for c in itertools.product((-1, 0, 1), repeat=3) if sum(c) == total)


# --- 6


def test_chat(spark):
    rng = random.Random(9)
    parts = ["<", "\\", "s>", "/s>", "[", "INST]", "/INST]", " ", "a", "/", "word ", "é", "\n"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(3000):
        t = text(rng.randint(0, 9))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in (chat.BEGIN, chat.ROLE, chat.TEXT, chat.END))
    rows = [(c, t, "system" if not t and c % 2 else rng.choice(["user", "assistant", None, "[INST]"]), None if rng.random() < 0.1 else text(rng.randint(0, 300))) for c in range(30) for t in range(rng.randint(1, 25))]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tokens int").repartition(5)
    for template in (chat.Template(), chat.Template(60, 30), chat.Template(5, 0)):
        got = {r.conv_id: r for r in chat.round_trip(frame, template).collect()}
        by = collections.defaultdict(list)
        for c, t, role, said in [*rows, *chat.PROBE]:
            by[c].append((t, role or "", said or ""))
        assert got.keys() == by.keys()
        for c, turns in by.items():
            turns.sort()
            every = "".join(f"{r}\n{s}\n" for _, r, s in turns)
            loss = "".join(s for _, r, s in turns if r == "assistant")
            g = got[c]
            assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        windows = chat.format_conversations(frame, template).collect()
        assert all(w.tokens <= template.budget or w.turns - w.repeated == 1 for w in windows)
    assert chat.format_conversations(frame.limit(0)).count() == 0
    # rows without conv_id are one conversation, and a very long turn is a window of its own
    odd = spark.createDataFrame([(None, 1, "user", "a"), (None, 0, None, None), (5, 0, "assistant", "x " * 50000)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.round_trip(odd).collect()}
    assert got[None].n_turns == 2 and got[None].turns_sha256 == hashlib.sha256(b"\n\nuser\na\n").hexdigest() and got[5].loss_chars == 100000


# --- 7


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b", "a\nb"),
        ("<body><div id=menu><a href=x>m</a></div><div class='post'><h1>T</h1><p>One two three four five six.</p><p>s</p><ul><li>i<li>j</ul></div><div class='comments'><p>a very long comment, long, long, long, long</p></div><form>f<input></form></body>", "T\nOne two three four five six.\ns\ni\nj"),
        ("<main><p>x &lt;b&gt; &amp;amp; &eacute;&#x41;\n\n b<aside>no</aside><script>var a='</p>'</script><table><tr><td>c<td>d</table></main><footer>f</footer>", "x <b> &amp; éA b\nc\nd"),
        ("<nav><a>n</a></nav><!-- <p>hidden</p> --><article><p><b>bold<br><p>next</p></article>", "bold\nnext"),
        ("<script>only()</script>", ""),
    ],
)
def test_html(page, text):
    assert htmltext.main_text(page) == text


LINE = "Some words of an article that goes on for a while, as articles do, and then ends. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # readers' comments in article elements of their own
        (f"<main><article><h1>T</h1><p>{LINE}<p>{LINE}</article><section id='comments'><article class='comment'><p>{LINE * 3}</article></section></main>", f"T\n{LINE}\n{LINE}"),
        (f"<article><h1>T</h1><p>{LINE}<p>ok<div class='post-comments'><article><p>{LINE * 9}</article></div></article>", f"T\n{LINE}\nok"),
        # names inside other names and values say nothing
        (f"<div><p title='hidden gems of Rome'>{LINE}</p><p data-id='share'>{LINE}</p><p class='share-price'>{LINE}</p></div>", f"{LINE}\n{LINE}\n{LINE}"),
        (f"<div class='legal-analysis'><h2 id='legal'>{LINE}</h2><p id='search'>{LINE}</p><p class='note'>{LINE}</p></div>", f"{LINE}\n{LINE}\n{LINE}"),
        # without any telling tag or name: a menu, a sidebar, a footer
        (
            "<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><div><h1>A title of some words here</h1>"
            + f"<p>{LINE * 3}</p><p>{LINE * 2}</p><p>Short.</p></div><div><h3>More</h3><ul><li><a href=4>One thing</a><li><a href=5>Other thing</a></ul><b>x</b><i>y</i></div><div>(c) <a href=6>us</a></div>",
            f"A title of some words here\n{LINE * 3}\n{LINE * 2}\nShort.",
        ),
        # without any link at all
        (f"<div><div>a</div><div>b</div><div>c</div><div>d</div></div><div><p>{LINE}</p><p>{LINE * 2}</p></div><div>e</div>", f"{LINE}\n{LINE * 2}"),
        # an article in parts, a second one beside it, text between, an advert in a box without a name
        (f"<div><article><h1>T</h1><div><p>{LINE * 3}<p>{LINE * 3}</div><p>end</article><article><p>{LINE * 2}<p>{LINE * 2}</article><div><i>buy</i> <b>this</b> <i>now</i></div></div>", f"T\n{LINE * 3}\n{LINE * 3}\nend\n{LINE * 2}\n{LINE * 2}"),
        (f"<article><header><h1>Title</h1></header>Bare text <p>{LINE}</p> and more<footer>f</footer></article>", f"Title\nBare text\n{LINE}\nand more"),
        (f"<form><div><p>{LINE}</p><p>{LINE}</p><input><select><option>o</select></div></form>", f"{LINE}\n{LINE}"),
        (f"<div class='notice'>We use cookies on this page.</div><p hidden>{LINE}</p><div role=banner>b</div><div><p>{LINE}<p>{LINE}</div>", f"{LINE}\n{LINE}"),
        # equal densities
        ("<div><p>same</p></div><div><p>same</p></div>", "same\nsame"),
    ],
)
def test_html_by_density(page, text):
    assert htmltext.main_text(page) == "\n".join(x.strip() for x in text.split("\n"))


def test_html_without_telling_tags(spark):
    """The pages' articles are found by density alone, in elements that don't say what they are."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)(article|nav)", "$1div"))
    wanted = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    got = {r.page_id: r.text for r in htmltext.extract(plain).collect()}
    assert got == wanted


def test_html_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("n_chars", F.lit("clash"))
    odd = spark.createDataFrame([(None, None, None, "c"), (1, "u", "", "c"), (2, "u", "<p>" * 5000 + "deep", "c")], pages.schema)
    got = {(r.page_id, r.url): r for r in htmltext.extract(pages.unionByName(odd)).collect()}
    assert got[None, None].text == "" and got[1, "u"].n_chars == 0 and got[2, "u"].text == "deep"
    for r in pages.collect():
        body = r.html[r.html.index("<article>") :].split("</article>")[0]
        blocks = re.sub("<[^>]*>", "", re.sub("</?(p|h1|article)>", "\x00", body.replace("<br>", " "))).split("\x00")
        wanted = "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
        assert got[r.page_id, r.url].text == wanted
    assert htmltext.extract(pages.limit(0)).count() == 0


# --- 8


def test_language_forward():
    pieces = langid.Pieces(["a", "b", "ab", "é", "ba"], ["a", "ab", "aba"])
    model = langid.fit([("abab a ba. ab", "x"), ("baba bé b", "y")], pieces)
    inside = {p: i for i, p in enumerate(pieces.inside)}
    begin = {p: i + len(pieces.inside) for i, p in enumerate(pieces.begin)}

    def brute(word, k):
        alpha = [model.p[-2, k], *[0.0] * len(word)]
        for j in range(1, len(word) + 1):
            for s in range(j):
                x = word[s:j]
                alpha[j] += alpha[s] * (model.p[inside[x], k] if x in inside else langid._STRANGE if j - s == 1 else 0)
                if s == 0 and x in begin:
                    alpha[j] += model.p[begin[x], k]
        return math.log(alpha[-1])

    texts = ["Abab, BA é!", "", None, "12 --", "zzz ab"]
    total, count = model.scores(*textkernel.utf8(pa.array(texts)))
    for t, row in zip(texts, total, strict=True):
        found = re.findall(r"[^\W\d_]+", (t or "").lower())
        assert np.allclose(row, [sum(brute(w, k) for w in found) for k in range(2)])
    assert np.allclose(model.p.sum(0), 1)
    lang, score = model.predict(*textkernel.utf8(pa.array(texts)))
    assert [x == langid.UNKNOWN for x in lang] == [False, True, True, True, False] and score[1] == 0


def test_language_of_long_words(monkeypatch):
    """A run of letters of any length is summed over all its segmentations, as the lattice does for short ones."""
    pieces = langid.Pieces(["a", "b", "ab", "é", "ba"], ["a", "ab", "aba"])
    model = langid.fit([("abab a ba. ab", "x"), ("baba bé b", "y")], pieces)
    texts = ["ababba" * 5, "abzéba" * 4 + " b", "漢字" * 9]
    wanted, _ = model.scores(*textkernel.utf8(pa.array(texts)))
    monkeypatch.setattr(langid, "_LETTERS", 2)
    got, _ = model.scores(*textkernel.utf8(pa.array(texts)))
    assert np.allclose(got, wanted)
    total, _ = model.scores(*textkernel.utf8(pa.array(["ab" * 10000])))
    assert np.isfinite(total).all() and (total < -10000).all()


def test_language_held_out(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert langid.predict(nothing).count() == 0


def test_language_odd(docs):
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[100].lang_pred == "en"
    assert langid.keep_known(docs).columns == docs.columns


# --- 9


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_contamination(spark, docs, nothing, block):
    token = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: token.findall(lower(t))
    known = [r.text for r in docs.where("doc_id >= 100").orderBy("doc_id").collect()]
    items = [(1, known[0]), (2, known[0]), (3, " ".join(known[3].split()[10:30])), (4, "one"), (5, ""), (6, None), (7, "w " * 40), (8, "never seen anywhere at all"), (9, "é ß 漢字"), (None, known[0]), (None, known[5]), (None, None)]
    benchmark = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n_hit int")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for p in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[p : p + 13])] |= {i} - {None}
    wanted = []
    for r in docs.collect():
        w, hit, found = cut(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        wanted.append(str((r.doc_id, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))))
    got = decontaminate.contamination(docs, benchmark, block_bytes=block)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(wanted)
    assert got.columns[: len(docs.columns)] == docs.columns
    matched = 0
    for r in got.collect():
        w, best = cut(r.text), 0
        for _, t in items:
            v = cut(t)
            for p, q in itertools.product(range(len(w)), range(len(v))) if r.n_hit and len(w) * len(v) < 10000 else ():
                n = sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(w[p:], v[q:], strict=False)))
                best = max(best, n) if n >= min(13, len(v)) else best
        if best:
            m, matched = r.longest_match, matched + 1
            assert m.n_words == best
            assert any(i == m.item_id and cut(t)[m.item_word : m.item_word + best] == w[m.doc_word : m.doc_word + best] for i, t in items)
        elif not r.n_hit:
            assert r.longest_match is None
    assert matched > 3
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.decontaminate(docs, benchmark).columns == docs.columns


def test_suffix_order():
    rng = np.random.default_rng(2)
    words = np.append(rng.integers(0, 4, 400), 0)
    places = np.flatnonzero(words)
    order = decontaminate.suffix_array(words, places, 500)
    suffix = lambda p: list(itertools.takewhile(bool, words[p:].tolist()))
    assert [suffix(p) for p in order] == sorted(suffix(p) for p in places)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e"), (2, "b c d y")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c d z")], "item_id long, text string")
    got = decontaminate.longest_matches(docs, items, window=3).select("item_word", "n_words").collect()
    assert {(0, 4), (1, 3)} <= {tuple(r) for r in got}


# --- 10


def test_toxicity(spark, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, None), (-2, "x" * 100000, None, None, None)], docs.schema)
    rows = toxicity.predict(docs.unionByName(odd), labels.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == 1003 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in bad for b in good]) > 0.75
    assert toxicity.predict(nothing, labels).count() == 0
    assert toxicity.predict(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_toxicity_finds_what_is_marked(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.predict(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in held}
    # some 5% of the toxic ones are junk without any word that marks the others
    assert share[1] >= 0.9 and share[0] <= 0.03


def test_toxicity_by_plain_python():
    """Scores come from the two compressors' lengths of each window alone."""
    rng = random.Random(21)
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(120)]
        if i % 4 == 0:
            for at in rng.sample(range(120), 4):
                w[at] = rng.choice(["grubnax", "snorkfizz", "vexmog"])
        rows.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.fit(rows)
    c = model.compressors
    assert b"grubnax" in c.toxic and b"snorkfi" in c.toxic and b"vexmog" in c.toxic and b"grubnax" not in c.ordinary
    text = rows[0][0] + " " + "snorkfizz"
    evidence = []
    for w in re.findall(r"[^\W\d_]+", text):
        plain, both = (len(x.compress(f" {w} ".encode() + c.ordinary[-64:])) for x in (c._plain, c._both))
        evidence.append(model.evidence.reshape(16, 13)[min(len(w), 15), min(max(plain - both, -3), 9) + 3])
    assert model.features(c.cells(toxicity.words(text))) == pytest.approx(model.features(np.arange(16 * 13)[[int(np.flatnonzero(model.evidence == e)[0]) for e in evidence]]))
    assert all((model.score(t) >= 0.5) == bool(y) for t, y in rows)
    # repeated rows and ties change nothing, and one class alone is no model
    assert toxicity.fit(rows * 2).score(text) == model.score(text)
    assert toxicity.fit([r for r in rows if not r[1]]).score(text) == 0.0 and toxicity.fit([]).score("") == 0.0
    assert model.score("") == model.score("12 !") < 0.5


def test_toxic_stems():
    toxic = [f"some words here you idiot {i} friend" for i in range(30)]
    plain = [f"some words here you {i} friend" for i in range(300)]
    assert toxicity.toxic_stems(toxic, plain)[0].startswith("idio")


# --- queries and pipeline


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 14))
    assert set(queries()) | {"pipeline"} <= set(found)


def test_pipeline(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        kept = out.collect()
        if name != "mixing":
            assert out.columns == source.columns
            before = {r.doc_id: r for r in docs.collect()}
            assert all(before[r.doc_id] == r for r in kept) and len(kept) <= len(before)
        if name == "near_duplicates":
            left, seen = {r.doc_id for r in kept}, {i: set(shingles(r.text, 5)) for i, r in before.items()}
            near = lambda a, b: len(seen[a] & seen[b]) >= 0.8 * len(seen[a] | seen[b])
            assert len({r.text for r in kept}) == len(kept)
            assert all(any(near(i, j) for j in left if j < i) for i in before if i not in left)
        if name == "decontamination":
            items = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert decontaminate.contamination(out, items).where("contaminated").count() == 0
        docs = out if name == "mixing" else spark.createDataFrame(kept, source.schema)
    wanted = sorted(map(str, docs.collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == wanted


# --- 7, elements that share a name with what isn't an article


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>T</h1><p>{LINE * 4}</p><section id='discussion'><h2>Discussion</h2><p>{LINE}</p><p>{LINE}</p></section></article>", f"T\n{LINE * 4}\nDiscussion\n{LINE}\n{LINE}"),
        (f"<main><h1>T</h1><p>{LINE * 4}</p><section id='legal'><h2>Legal</h2><p>{LINE}</p></section><div class='search'><p>How search works.</p></div></main>", f"T\n{LINE * 4}\nLegal\n{LINE}\nHow search works."),
        (f"<article><h1>T</h1><p>{LINE * 4}</p><div class='social'><p>Social sciences differ.</p></div></article>", f"T\n{LINE * 4}\nSocial sciences differ."),
        (f"<div id=wrap><h1>Title</h1><div class=byline>By A. Person</div><div><p>{LINE * 3}</p><p>{LINE * 3}</p></div><p>Last short line.</p></div>", f"Title\nBy A. Person\n{LINE * 3}\n{LINE * 3}\nLast short line."),
        # what speaks against them: links, controls, no prose
        (f"<article><h1>T</h1><p>{LINE * 4}</p><div class='social'><p>Share: <a href=1>on one</a> <a href=2>on two</a></p></div><div class='search'><p>Search</p><input></div><div class='tags'>a b c</div></article>", f"T\n{LINE * 4}"),
        (f"<div id=wrap><h1>Title</h1><div><p>{LINE * 3}</p><p>{LINE * 3}</p></div><div>(c) <a href=1>us</a> 2020</div><ul><li><a href=2>one</a><li><a href=3>two</a></ul></div>", f"Title\n{LINE * 3}\n{LINE * 3}"),
        (f"<article><h1>T</h1><p>{LINE * 4}</p><section id='comments'><h2>Comments</h2><p>{LINE * 3}</p></section></article>", f"T\n{LINE * 4}"),
    ],
)
def test_html_names_that_are_topics(page, text):
    assert htmltext.main_text(page) == "\n".join(x.strip() for x in text.split("\n"))


def densities(node):
    """Composite text density by its definition, for each element, and the sums of children: by recursion over copies."""

    def chars(n, linked=False):
        own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        inner = [chars(c, linked or c.tag == "a") for c in n.children if not isinstance(c, str)]
        return own + sum(a for a, _ in inner), (own if linked else 0) + sum(b for _, b in inner)

    def tags(n):
        inner = [(c, tags(c)) for c in n.children if not isinstance(c, str)]
        return sum(1 + t for _, (t, _) in inner), sum((c.tag == "a") + t for c, (_, t) in inner)

    body_c, body_l = chars(node)
    out = {}

    def visit(n, linked):
        c, lc = chars(n, linked)
        t, lt = tags(n)
        density = 0.0
        if c:
            ratio = c / max(lc, 1) * max(t, 1) / max(lt, 1)
            base = math.log(c / max(c - lc, 1) * lc + body_l / max(body_c, 1) * c + math.e)
            density = c / max(t, 1) * math.log(ratio) / max(math.log(base), 0.1) if ratio > 1 else 0.0
        out[id(n)] = [density, None]
        inner = [c for c in n.children if not isinstance(c, str)]
        for x in inner:
            visit(x, linked or x.tag == "a")
        out[id(n)][1] = sum(out[id(x)][0] for x in inner) or density

    visit(node, False)
    return out


def test_html_densities_by_plain_python(spark):
    """Densities and density sums of every element, and the core that they choose."""
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").limit(30).collect()]
    pages += [f"<body><div><p>{LINE}<a href=1>x</a></p><p>{LINE * 2}</p></div><ul><li><a href=2>a b</a><li>c</ul></body>", "<p>a<p>b"]
    for page in pages:
        root = htmltext.parse(page)
        order = htmltext._weigh(root)
        body = next((n for n in order if n.tag == "body"), root)
        htmltext._score(order, body)
        exact = densities(body)
        for n in htmltext._under(body):
            assert math.isclose(n.density, exact[id(n)][0], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(n.total, exact[id(n)][1], rel_tol=1e-9, abs_tol=1e-12)
        best = max(v for n in htmltext._under(body) if n.tag not in htmltext.INLINE for v in [exact[id(n)][1]])
        core = max((n for n in htmltext._under(body) if n.tag not in htmltext.INLINE), key=lambda n: n.total)
        assert math.isclose(core.total, best, rel_tol=1e-9)


# --- clashing names and odd rows through the whole pipeline

CLASHES = ["__found", "__hit", "__toxic", "__size", "__id", "score", "n_words", "pos", "stats"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    good = source.where("lang = 'en' and length(text) between 500 and 900").limit(1).first().text
    odd = [(9001, None, "en", "s", 1), (9002, "", "en", "s", 0), (None, good + " and so on", None, None, None), (9003, good, None, "s", 3), (9003, good, None, "s", 3), (9004, (good + "\n") * 300, "en", "s", 9)]
    docs = source.unionByName(spark.createDataFrame(odd, source.schema))
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(i))
    folder = tmp_path / "odd"
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(folder))
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken", "copies"]
    rows = out.collect()
    assert len(rows) > 50 and all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in rows)
    assert not {9001, 9002} & {r.doc_id for r in rows}
    assert len([r for r in rows if r.text == good]) <= 2  # copies under one doc_id stay together

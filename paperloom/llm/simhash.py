"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text becomes 64 bits, a majority over its word shingles' XXH64. Bits that go together over
all fingerprints are put in one partition; dynamic programming gives the partitions thresholds
of -1, 0, 1 or 2 that sum to `limit - partitions + 1`, at the least estimated cost of probes and
candidates. By the generalised principle any two fingerprints within `limit` bits agree, in one
partition at least, up to its threshold, so probing finds all links. Candidates are verified
where they meet, and what leaves a task are spanning stars, at most a row per fingerprint and
bucket, never a group's pairs. A bucket with more than `BUCKET` fingerprints is split by the same
principle over its free bits until it is small, so no group meets in one task.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, star_edges
from .minhash import MinHash
from .sets import Sets, arrays, runs
from .shared import fresh_path, written
from .textkernel import shingle_hashes, slices, utf8

BITS = 64
#: Fingerprints, of 8 bytes, that are compared in one task without further splitting.
BUCKET = 1 << 14
#: Estimated cost of moving a probe, in candidate comparisons.
PROBE_COST = 200.0


def simhash(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprint of each text: a bit is 1 if set in over half of the shingle hashes; 0 without words."""
    hashes, begin = shingle_hashes(data, offsets, shingle, seed)
    count = np.diff(begin)
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        ones = np.empty((len(full), BITS), np.int64)
        at = 0
        while at < len(full):  # bounded: bits take 64 bytes a shingle
            to = max(at + 1, int(np.searchsorted(begin[full], begin[full[at]] + (1 << 18))))
            rows = full[at:to]
            span = hashes[begin[rows[0]] : begin[rows[-1] + 1]]
            bits = np.unpackbits(span.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[at:to] = np.add.reduceat(bits, begin[rows] - begin[rows[0]], axis=0, dtype=np.int64)
            at = to
        major = (2 * ones > count[full, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fp` of each row; a null text counts as empty, and its fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = simhash(*utf8(part.column("text")), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- partitions and thresholds


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Over all rows, how many there are and how many have both bits of each pair set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            rows += len(fp)
        i, j = np.nonzero(total)
        i, j, n = np.append(i, BITS), np.append(j, BITS), np.append(total[i, j], rows)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n.astype(np.int64))], ["i", "j", "n"])

    got = nodes.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, rows = np.zeros((BITS, BITS)), 0
    for i, j, n in got:  # 4,097 rows at most
        if i == BITS:
            rows = n
        else:
            both[i, j] = n
    return rows, both


def group_bits(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of nearly equal size; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    phi = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        seed = max(left, key=lambda b: (phi[b, sorted(left)].sum(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            bit = max(left, key=lambda b: (phi[b, group].sum(), -b))
            group.append(bit)
            left.discard(bit)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a partition, that sum to `total` at the least cost; cost[i][t] is that of t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in options.items():
                if s + t not in step or c + more < step[s + t][0]:
                    step[s + t] = (c + more, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _flips(bits: list[int], threshold: int) -> list[int]:
    return [_mask(list(c)) for t in range(threshold + 1) for c in itertools.combinations(bits, t)]


def plan(nodes: DataFrame, limit: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, over whichever number of partitions costs least."""
    rows, both = bit_counts(nodes)
    p = np.diag(both) / max(rows, 1)
    layouts = {m: group_bits(rows, both, m) for m in sorted({2, 3, (limit + 4) // 2, limit + 1, limit + 2})}
    keys = F.array(
        *(
            F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("key"))
            for m, groups in layouts.items()
            for i, bits in enumerate(groups)
        )
    )
    same = {
        (m, i): float(n)
        for m, i, n in nodes.select(F.explode(keys).alias("k"))
        .groupBy("k.m", "k.i", "k.key")
        .agg(F.count("*").cast("double").alias("n"))
        .groupBy("m", "i")
        .agg(F.sum(F.col("n") * F.col("n")))
        .collect()
    }
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m, groups in layouts.items():
        cost = []
        for i, bits in enumerate(groups):
            options = {-1: 0.0}
            # a flip of bit b meets the pairs that differ in it: estimated from how often the bit is set
            ratio = [1 / max(p[b] ** 2 + (1 - p[b]) ** 2, 0.5) - 1 for b in bits]
            meet = [1.0, sum(ratio), (sum(ratio) ** 2 - sum(r * r for r in ratio)) / 2]
            for t in range(min(2, limit) + 1):
                options[t] = PROBE_COST * rows * len(_flips(bits, t)) + same.get((m, i), 0.0) * sum(meet[: t + 1])
            cost.append(options)
        c, chosen = allocate(cost, limit - m + 1)
        if c < best[0]:
            best = (c, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


# --- probe and verify


def _members(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """`mask, value, fp`: each fingerprint in its own bucket of each partition and in those within its threshold."""
    rows: list[Column] = []
    for bits, threshold in parts:
        mask = F.lit(_mask(bits))
        own = F.col("fp").bitwiseAND(mask)
        rows += [F.struct(mask.alias("mask"), own.bitwiseXOR(F.lit(x)).alias("value"), F.col("fp").alias("fp")) for x in _flips(bits, threshold)]
    return nodes.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _split(hot: DataFrame, masks: list[int], limit: int) -> tuple[DataFrame, list[int]]:
    """Members of the buckets in `hot`, by limit + 1 groups of the bits that their mask leaves free."""
    children: dict[int, list[int]] = {}
    for mask in masks:
        free = [b for b in range(BITS) if not mask >> b & 1]
        children[mask] = [_mask(free[k :: limit + 1]) for k in range(limit + 1)]
    table = F.create_map(*(x for m, own in children.items() for x in (F.lit(m), F.array(*map(F.lit, own)))))
    rows = hot.select("mask", "value", "fp", F.explode(table[F.col("mask")]).alias("more")).select(
        F.col("mask").bitwiseOR(F.col("more")).alias("mask"),
        F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.col("more"))).alias("value"),
        "fp",
    )
    return rows, sorted({m | c for m, own in children.items() for c in own})


def verified_stars(value: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints sorted by bucket, spanning stars of the links within buckets. Runs of few members
    are compared by shifts over all runs at once, longer ones in blocks."""
    word = fp.view(np.uint64)  # of a signed number, NumPy would count the bits of its absolute value
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(value)))
    run = np.repeat(np.arange(len(size)), size)
    short = size <= 48
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    left = np.flatnonzero(np.repeat(short & (size > 1), size))
    shift = 1
    while len(left):
        left = left[left + shift < len(run)]
        left = left[run[left] == run[left + shift]]
        near = left[np.bitwise_count(word[left] ^ word[left + shift]) <= limit]
        us.append(fp[near])
        vs.append(fp[near + shift])
        shift += 1
    for k in np.flatnonzero(~short):
        x = fp[begin[k] : begin[k] + size[k]]
        w = word[begin[k] : begin[k] + size[k]]
        for at in range(0, len(x), 128):
            i, j = np.nonzero(np.bitwise_count(w[at : at + 128, None] ^ w[None, at:]) <= limit)
            pair = j > i
            u, v = star_edges(x[at : at + 128][i[pair]], x[at:][j[pair]])
            us.append(u)
            vs.append(v)
    if not us:
        return np.zeros(0, fp.dtype), np.zeros(0, fp.dtype)
    return star_edges(np.concatenate(us), np.concatenate(vs))


def _links(members: DataFrame, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
                key, fp = np.concatenate([key, np.stack(cols[:2], 1)]), np.concatenate([fp, cols[2]])
                ends = len(fp) - int(np.argmin(np.append((key[::-1] == key[-1]).all(1), False))) if len(fp) else 0
            else:
                ends = len(fp)
            if ends:  # the last bucket may go on in the next batch
                value = np.cumsum(np.concatenate([[0], (key[1:ends] != key[: ends - 1]).any(1)]))
                u, v = verified_stars(value, fp[:ends], limit)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                key, fp = key[ends:], fp[ends:]

    ordered = members.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return ordered.mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, limit: int = 3, bucket: int | None = None) -> DataFrame:
    """`u, v`: links between the distinct fingerprints `fp` that connect all within `limit` bits."""
    bucket = bucket or BUCKET
    parts = plan(nodes, limit)
    members = _members(nodes, parts)
    masks = sorted({_mask(bits) for bits, _ in parts})
    found: list[DataFrame] = []
    while True:
        sizes = members.groupBy("mask", "value").agg(F.count("*").alias("n"))
        hot = sizes.where(F.col("n") > bucket).select("mask", "value")
        free = max(BITS - bin(m & (2**64 - 1)).count("1") for m in masks)
        if free <= limit + 1 or hot.limit(1).count() == 0:
            found.append(_links(members, limit))
            break
        hot = written(hot, "hot")
        found.append(_links(members.join(hot, ["mask", "value"], "left_anti"), limit))
        members, masks = _split(members.join(hot, ["mask", "value"]), masks, limit)
        members = written(members, "members")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, limit: int = 3, shingle: int = 3, seed: int = 42, bucket: int | None = None) -> DataFrame:
    """`doc_id, fingerprint, component_id` of each row of `docs` (doc_id, text, any others).

    Fingerprints link at `limit` or fewer differing bits; component_id is the least doc_id that
    links reach, itself included. Equal fingerprints are one node, so copies cost no comparison.
    Null and wordless texts have fingerprint zero and link like any other; a row without doc_id
    takes part and gets its component's least doc_id, null if no row of it has one; repeated
    rows each get a row; an empty table gives none.
    """
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes, limit, bucket)).select(F.col("node").alias("fp"), "root")
    labelled = written(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    component = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.join(component, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of the shingles that similarity is measured on, and the similarity from which a document is a near-duplicate.
SIMILAR_WORDS, SIMILAR = 5, 0.8


#: Signatures whose bands find what fingerprints miss: texts that are 0.8 alike share one of the 25 bands with odds of 0.99995.
BANDS = MinHash(functions=125, shingle=SIMILAR_WORDS, rows=5)


def _described(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """`doc_id, fp, digest, bands` of each row with an id; equal texts have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                raw = data.tobytes()
                digest = [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in itertools.pairwise(offsets.tolist())]
                fp = simhash(data, offsets, shingle, seed).view(np.int64)
                bands = BANDS.band_keys(BANDS.signatures(data, offsets)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * BANDS.bands), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), pa.array(digest, pa.binary()), lists], ["doc_id", "fp", "digest", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, fp long, digest binary, bands array<long>")


def _candidates(texts: DataFrame, limit: int) -> DataFrame:
    """`u, v`: links between the doc_ids of `texts` (doc_id, fp, bands) that connect all with fingerprints within `limit`
    bits, and all that share a band."""
    near = links(texts.select("fp").distinct(), limit)
    of = texts.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    near = near.join(of.toDF("u", "a"), "u").join(of.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    keys = texts.select("doc_id", F.explode(F.concat("bands", F.array(F.xxhash64("fp")))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    return near.union(keys.join(shared, "key").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v"))


#: Shingles, and TEXT more for each text, that one task compares with one another. A larger group is gone through by
#: its texts of least doc_id, about as many a round, which the rest meets in slices of SLICE times as much.
GROUP, TEXT, SLICE = 1 << 18, 64, 4


def _shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """`doc_id, root, shingles` (sorted distinct hashes), `n` (what they count towards a group) of rows `doc_id, root, text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, begin = shingle_hashes(*utf8(part.column("text")), words)
                sets = [np.unique(hashes[i:j]).view(np.int64) for i, j in itertools.pairwise(begin)]
                n = pa.array([len(x) + TEXT for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("root"), pa.array(sets, pa.list_(pa.int64())), n], ["doc_id", "root", "shingles", "n"])

    return rows.select("doc_id", "root", "text").mapInArrow(run, "doc_id long, root long, shingles array<long>, n long")


def first_kept(sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sets stay if, in order, each goes that is similar to an earlier one that stays."""
    index, stays = Sets(sets, SIMILAR), np.ones(len(sets), bool)
    for i, x in enumerate(sets):
        if stays[i]:
            near = index.similar(x)
            near[: i + 1] = False
            stays &= ~near
    return stays


def _led(block: DataFrame) -> DataFrame:
    """`block` (doc_id, root, shingles, n) with `stays`, by what comes before in the same root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["root"]):
            stays = first_kept(arrays(rows.column("shingles")))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(stays)], [*rows.schema.names, "stays"])

    rows = block.select("doc_id", "root", "shingles", "n").repartition("root").sortWithinPartitions("root", "doc_id")
    return rows.mapInArrow(run, "doc_id long, root long, shingles array<long>, n long, stays boolean")


def _met(leaders: DataFrame, others: DataFrame) -> DataFrame:
    """`others` (root, salt, doc_id, shingles, n) with `similar`: whether a leader of their slice is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["root", "salt"]):
            leads = rows.column("leads")
            index = Sets(arrays(rows.filter(leads).column("shingles")), SIMILAR)
            rest = rows.filter(pa.compute.invert(leads))
            similar = [bool(index.similar(x).any()) for x in arrays(rest.column("shingles"))]
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("doc_id", "root", "shingles", "n")), pa.array(similar, pa.bool_())], ["doc_id", "root", "shingles", "n", "similar"])

    columns = ["root", "salt", "doc_id", "shingles", "n"]
    both = leaders.select(*columns, F.lit(True).alias("leads")).union(others.select(*columns, F.lit(False).alias("leads")))
    rows = both.repartition("root", "salt").sortWithinPartitions("root", "salt")
    return rows.mapInArrow(run, "doc_id long, root long, shingles array<long>, n long, similar boolean")


def _repeats(rest: DataFrame) -> DataFrame:
    """`doc_id` of each row of `rest` (doc_id, root, shingles, n) that is similar to a row of the same root and lower
    doc_id that isn't one itself.

    In order of doc_id, what is similar to a text that stays goes. The least doc_ids of each root settle among
    themselves in one task, and what stays of them meets the others of the root in slices; so on until no text is
    left. A root of at most GROUP is settled in the first round, and where all are, that is the only one and nothing is
    sent to all tasks. Each round is written, so plans don't grow.
    """
    spark, path = rest.sparkSession, fresh_path(rest.sparkSession, "gone")
    while True:
        # at most a row for each GROUP of shingles, so they can be broadcast
        large = rest.groupBy("root").agg(F.sum("n").alias("total")).where(F.col("total") > GROUP)
        large = written(large.select("root", F.ceil(F.col("total") / (SLICE * GROUP)).cast("int").alias("salts")), "large")
        if large.limit(1).count() == 0:
            _led(rest).where("not stays").select("doc_id").write.mode("append").parquet(path)
            return spark.read.schema("doc_id long").parquet(path)
        salt = F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt")
        order = Window.partitionBy("root", "salt").orderBy("doc_id")
        run = rest.join(F.broadcast(large), "root").select("root", salt, "salts", "doc_id", "n")
        run = run.select("root", "doc_id", "salts", F.sum("n").over(order).alias("upto"), F.row_number().over(order).alias("place"))
        # the first of each slice is in, so the least doc_id of the root is
        ends = written(run.where("place > 1").where(F.col("upto") > GROUP / F.col("salts")).groupBy("root").agg(F.min("doc_id").alias("end")), "ends")
        placed = rest.join(F.broadcast(large.join(ends, "root")), "root", "left").select("doc_id", "root", "shingles", "n", salt, "end")
        led = written(_led(placed.where("end is null or doc_id < end")), "led")
        led.where("not stays").select("doc_id").write.mode("append").parquet(path)
        if ends.limit(1).count() == 0:
            return spark.read.schema("doc_id long").parquet(path)
        leaders = led.where("stays").join(F.broadcast(large.join(ends, "root")), "root").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        met = written(_met(leaders, placed.where("doc_id >= end")), "met")
        met.where("similar").select("doc_id").write.mode("append").parquet(path)
        rest = met.where("not similar").drop("similar")


def duplicate_ids(docs: DataFrame, limit: int, shingle: int, seed: int = 42) -> DataFrame:
    """`doc_id` of each document that a kept one repeats: equal to it, or near it and of a Jaccard similarity of
    0.8 or more over distinct five-word shingles.

    Copies go first, down to the least doc_id. Among the texts that fingerprints or bands connect, each in order of doc_id goes
    if it is as similar as asked to one that stays, so no two that stay are, but for those that neither connects.
    """
    described = written(_described(docs, shingle, seed), "described")
    texts = written(described.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
    copies = described.join(texts.select("digest", F.col("doc_id").alias("first")), "digest").where("doc_id <> first").select("doc_id")
    rooted = connected_components(_candidates(texts, limit)).select(F.col("node").alias("doc_id"), "root")
    members = written(rooted, "members")
    rest = written(_shingle_sets(members.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").dropDuplicates(["doc_id"]), SIMILAR_WORDS), "sets")
    return copies.union(_repeats(rest)).distinct()


def keep_first(docs: DataFrame, limit: int = 6, shingle: int = 2) -> DataFrame:
    """The rows of `docs` without near-duplicates, of which the document of least doc_id stays.

    Fingerprints and MinHash bands find what may be similar. Fingerprints take shorter shingles than those that similarity is
    measured on: a changed word changes fewer of them. Rows that share a doc_id stay or go together; a row without one stays.
    """
    return docs.join(duplicate_ids(docs, limit, shingle), "doc_id", "left_anti").select(docs.columns)

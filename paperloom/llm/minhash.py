"""MinHash document fingerprints.

Word shingles are hashed to 32 bits; each of the hash functions is the strongly universal
multiply-add-shift (a x + b mod 2^64) >> 32, and a text's signature keeps 16 bits of each
function's minimum. Functions and texts are vectorised in NumPy. Signature bands meet in Spark
joins, and exact Jaccard similarity verifies what meets.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, star_edges
from .ordered import with_successors
from .sets import Sets, arrays, runs
from .shared import written
from .textkernel import mix, shingle_hashes, slices, utf8

#: Shingles whose hashes are kept in cache while all functions run over them.
_BLOCK = 1 << 14


@dataclass(frozen=True)
class MinHash:
    """`functions` hash functions over shingles of `shingle` words; `bands` bands of `rows` values."""

    functions: int = 128
    shingle: int = 5
    seed: int = 42
    rows: int = 5

    @property
    def bands(self) -> int:
        return self.functions // self.rows

    def _coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        x = mix(np.arange(2 * self.functions, dtype=np.uint64) + np.uint64(self.seed << 32))
        return x[: self.functions] | np.uint64(1), x[self.functions :]

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, begin = shingle_hashes(data, offsets, self.shingle, self.seed)
        return hashes >> np.uint64(32), begin

    def signatures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """uint16 [texts, functions]; a text without words has all ones."""
        return self.of_shingles(*self.shingles(data, offsets))

    def of_shingles(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        a, b = self._coefficients()
        least = np.full((len(begin) - 1, self.functions), np.uint64(2**64 - 1))
        for at in range(0, len(x), _BLOCK):
            block = x[at : at + _BLOCK]
            low = int(np.searchsorted(begin, at, side="right")) - 1
            high = int(np.searchsorted(begin, at + len(block), side="left"))
            rows = np.arange(low, high)
            rows = rows[begin[rows + 1] > begin[rows]]  # reduceat can't take empty runs
            cut = np.maximum(begin[rows] - at, 0)
            v = np.empty_like(block)
            for i in range(self.functions):
                np.multiply(block, a[i], out=v)
                np.add(v, b[i], out=v)
                least[rows, i] = np.minimum(least[rows, i], np.minimum.reduceat(v, cut))
        return (least >> np.uint64(32)).astype(np.uint16)

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """uint64 [texts, bands]: a hash of each band's values, and of which band it is."""
        keys = np.tile(mix(np.arange(self.bands, dtype=np.uint64)), (len(signatures), 1))
        for i in range(self.rows):
            keys = mix(keys + signatures[:, i : self.bands * self.rows : self.rows])
        return keys


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values, an unbiased estimate of the shingle sets' Jaccard similarity."""
    return (a == b).mean(axis=1)


def hexed(signatures: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signatures.astype(">u2")]


def edited_texts(texts: list[str], following: list[str]) -> list[str]:
    """Each text with the last half of its code points replaced by as many first ones of the next (or all it has)."""
    return [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]


def fingerprint_with_edits(docs: DataFrame, hasher: MinHash | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text, any others): fingerprints of the text and of its edited text.

    The next document is by ascending doc_id, nulls first, equal ids by text; after the last comes
    the first, and a lone one follows itself. A null text counts as empty. Repeated rows stay rows.
    `shared_bands`, the number of signature bands in which text and edited text meet, comes last.
    """
    hasher = hasher or MinHash()
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, which waits for its successor
        for batch in batches:
            for part in slices(batch, "text"):
                rows = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks().to_batches()[0]
                held = rows.slice(rows.num_rows - 1)
                if rows.num_rows == 1:
                    continue
                emit = ~rows.column("__last").to_numpy(zero_copy_only=False)[:-1]
                column = rows.column("text")
                column = column.fill_null("") if column.null_count else column
                own = hasher.signatures(*utf8(column))
                texts = column.to_pylist()
                edited = edited_texts(texts[:-1], texts[1:])
                changed = hasher.signatures(*utf8(pa.array(edited, pa.large_string())))
                bands = (own[:-1, : hasher.bands * hasher.rows] == changed[:, : hasher.bands * hasher.rows]).reshape(-1, hasher.bands, hasher.rows).all(2).sum(1)
                out = [
                    rows.column("doc_id").slice(0, rows.num_rows - 1),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(hexed(own[:-1])),
                    pa.array(hexed(changed)),
                    pa.array(likeness(own[:-1], changed)),
                    pa.array(likeness(own[:-1], own[1:])),
                    pa.array(bands.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(emit))

    rows = with_successors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    return rows.mapInArrow(run, schema)


# --- near-duplicates


def _signed(docs: DataFrame, hasher: MinHash) -> DataFrame:
    """`doc_id, fingerprint, shingles` (sorted distinct 32-bit hashes, as longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, begin = hasher.shingles(*utf8(part.column("text")))
                sets = [np.unique(x[i:j]).astype(np.int64) for i, j in itertools.pairwise(begin)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(hexed(hasher.of_shingles(x, begin))), pa.array(sets, pa.list_(pa.int64()))],
                    ["doc_id", "fingerprint", "shingles"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, shingles array<long>")


#: Nodes of a bucket that one task compares with one another; a larger bucket is compared slice by slice.
BLOCK = 1 << 11


def _verified(members: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """`u, v`: spanning stars of the pairs of `members` (keys, node, root, shingles) that share the keys, are as similar as
    asked, and aren't connected yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            node, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root"))
            sets = arrays(rows.column("shingles"))
            index = Sets(sets, threshold)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, x in enumerate(sets):
                near = np.flatnonzero(index.similar(x) & (root != root[i]))
                us.append(np.full(len(near), node[i]))
                vs.append(node[near])
            u, v = star_edges(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = members.select(*keys, "node", "root", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, hasher: MinHash | None = None) -> DataFrame:
    """`doc_id, fingerprint, component_id` per row: classes of texts linked by a Jaccard similarity of
    `threshold` or more over distinct shingles.

    Equal fingerprints are one node, so copies are never paired. Nodes meet by signature band, and exact Jaccard verifies
    what meets. Each node is first held against its bucket's least one. Buckets whose nodes these links don't
    connect are then compared whole, by pairs of slices of BLOCK nodes if they are larger, so all that meet
    are connected as their similarities say, and no group's pairs leave a task. Null and wordless texts are one class;
    a null doc_id never names one; an empty table gives no row.
    """
    hasher = hasher or MinHash()
    signed = written(_signed(docs, hasher), "minhash")
    nodes = written(
        signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.min_by("shingles", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("shingles")).withColumn("node", F.xxhash64("fingerprint")),
        "minhash-nodes",
    )
    width = 4 * hasher.rows
    bands = [F.xxhash64(F.lit(i), F.substring("fingerprint", 1 + i * width, width)) for i in range(hasher.bands)]
    keys = nodes.select("node", F.explode(F.array(*bands)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    buckets = written(keys.join(shared, "key"), "minhash-buckets")
    sets = nodes.select("node", "shingles")
    # a node and the least of its bucket
    pairs = buckets.where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    common = F.size(F.array_intersect("a", "b"))
    links = written(both.where(common >= threshold * (F.size("a") + F.size("b") - common)).select("u", "v"), "minhash-links")
    roots = connected_components(links).select("node", "root")
    rooted = buckets.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a bucket matters if it holds more than one root; buckets of the same nodes are compared once
    apart = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("same")).where("a <> b")
    apart = apart.groupBy("n", "same").agg(F.min("key").alias("key")).withColumn("slices", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    left = rooted.join(apart, "key").withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    left = left.select("key", "node", "root", "slice", other.alias("other")).select("key", "node", "root", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"))
    more = _verified(left.join(sets, "node"), ["key", "low", "high"], threshold)
    roots = connected_components(links.union(more)).select("node", "root")
    labelled = written(nodes.join(roots, "node", "left").select("fingerprint", "least", F.coalesce("root", "node").alias("root")), "labelled")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.select("doc_id", "fingerprint").join(labelled.join(least, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")

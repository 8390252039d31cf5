"""Exact retrieval, reranking, chunk lookup and classification, for any number of queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_text

TOP_K, RERANK_K = 20, 10
#: Query vectors' bytes that are broadcast at once; more queries are taken in blocks.
QUERY_BYTES = 32 << 20
#: Bytes of scores, and of entries' vectors, that a task holds at once, however many queries and entries there are.
SCORE_BYTES = 8 << 20
#: Places that scores are rounded to before they are compared, so that engines agree on ties.
PLACES = 6


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each length, and their vectors; null vectors are left out."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield rows, flat.reshape(len(rows), n)


class _Best:
    """The k best entries so far of some queries, the smaller index first among equals; -inf where there are fewer."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score, self.entry = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, entries: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, SCORE_BYTES // (8 * max(1, len(entries))))
        for at in range(0, len(self.ids), step):
            score = self.vectors[at : at + step] @ vectors.T
            np.round(score, PLACES, out=score)
            score[np.isnan(score)] = -np.inf
            self._merge(at, score, entries)

    def _merge(self, begin: int, score: np.ndarray, entries: np.ndarray) -> None:
        # only what reaches a query's k-th score is sorted
        low = self.score[begin : begin + len(score), -1]
        if score.shape[1] > self.k and np.isneginf(low).any():
            low = np.maximum(low, np.partition(score, -self.k, axis=1)[:, -self.k])
        row, at = np.nonzero((score >= low[:, None]) & (score > -np.inf))
        rows, place = np.unique(row, return_inverse=True)
        own = begin + rows
        row = np.append(np.repeat(np.arange(len(rows)), self.k), place)
        value, entry = np.append(self.score[own], score[rows[place], at]), np.append(self.entry[own], entries[at])
        order = np.lexsort((entry, -value, row))
        first = np.searchsorted(row[order], np.arange(len(rows)))
        best = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.entry[own] = value[best], entry[best]

    def rows(self) -> pa.RecordBatch:
        row, at = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row].astype(np.int64)), pa.array(self.entry[row, at]), pa.array(self.score[row, at])], ["query_id", "index", "score"])


def top_k(queries: DataFrame, index: DataFrame, k: int = TOP_K, normalized: bool = False) -> DataFrame:
    """`query_id, index, score, rank`: for each query (`query_id, embedding`) the k entries of `index` (`index, embedding`)
    of largest inner product, the smaller index first among equals; vectors are normalised unless they are.

    The index stays where it is: each task multiplies some of its rows at a time with a block of queries and passes on its own
    k best, so k rows per query and task are shuffled. A query is held against the entries of its own length, whatever lengths other
    queries or entries have; without such entries, or if it is null, it has no hits.
    """
    rows = queries.select(F.col("query_id").cast("long"), "embedding").where("embedding is not null")
    total = rows.agg(F.sum(F.size("embedding"))).first()[0]
    blocks = max(1, -(-8 * (total or 0) // QUERY_BYTES))
    spark, found = index.sparkSession, None
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        ids, vectors = part["query_id"].to_numpy(), part["embedding"].combine_chunks()
        asked = {m.shape[1]: (ids[at], m if normalized else _unit(m)) for at, m in _matrices(vectors)} if len(ids) else {}
        shared = spark.sparkContext.broadcast(asked)  # QUERY_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {n: _Best(*own, k) for n, own in shared.value.items()}
            step = max(1, SCORE_BYTES // (8 * max([1, *best])))  # entries, by the bytes of their vectors
            for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows if best else 0, step)):
                own = batch.column("index").to_numpy(zero_copy_only=False)
                for at, m in _matrices(batch.column("embedding")):
                    if m.shape[1] in best:
                        best[m.shape[1]].add(own[at], m if normalized else _unit(m))
            yield from (x.rows() for x in best.values())

        entries = index.select(F.col("index").cast("long").alias("index"), "embedding").where("embedding is not null and index is not null")
        local = entries.mapInArrow(run, "query_id long, index long, score double")
        found = local if found is None else found.unionByName(local)
    return ranked(found, "score", k, ["index"])


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True)) if m.size else np.ones((len(m), 1))
    return m / np.where(n == 0, 1.0, n)


def ranked(hits: DataFrame, score: str, k: int, ties: list[str]) -> DataFrame:
    """The k best hits of each query, ranked from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), *ties)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_entries(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits with their key, text and chunk ids; an unknown index has nulls and no chunks. The few hits go to the index,
    whose other entries aren't moved."""
    found = index.select("index", "key", "text", "chunk_ids").join(hits.select("index").distinct(), "index", "left_semi")
    rows = hits.join(found, "index", "left")
    return rows.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<bigint>")))


def overlap_score(query: Column, text: Column) -> Column:
    """The stand-in pair scorer: shared words over all words of both (Jaccard), 4 places."""
    bag = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), "[^a-zà-ỹđ0-9]+"), lambda w: w != ""))
    a, b = bag(query), bag(text)
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 4)


def rerank(hits: DataFrame, queries: DataFrame, k: int = RERANK_K, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The k best of each query's hits with text by the pair scorer, equal ones in order of retrieval; adds `rerank_score, new_rank`."""
    texts = queries.select("query_id", query_text(F.col("query")).alias("query")).where("query is not null")
    rows = hits.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(texts, "query_id").withColumn("rerank_score", scorer(F.col("query"), F.col("text"))).drop("query")
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)


def first_chunks(hits: DataFrame, n: int | None = None, rank: str = "rank") -> DataFrame:
    """`query_id, chunk_id, place`: the distinct chunks of each query's hits in order of first occurrence, the first n."""
    seen = hits.select("query_id", F.col(rank).alias("r"), F.posexplode("chunk_ids").alias("p", "chunk_id"))
    first = seen.groupBy("query_id", "chunk_id").agg(F.min(F.struct("r", "p")).alias("f"))
    rows = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("f.r", "f.p"))).drop("f")
    return rows if n is None else rows.where(F.col("place") <= n)


def lookup(chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chosen chunks that exist (`chunks` has `chunk_id`)."""
    return chosen.join(chunks, "chunk_id")


#: Fixed value: the text of a query without chunks.
NO_CHUNK = "(Không có chunk nào)"


def chunk_text(found: DataFrame, text: str = "chunk_text", queries: DataFrame | None = None) -> DataFrame:
    """`query_id, text`: a query's chunks in order, a blank line between them. Of `queries` those without chunks have a text
    that says so."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", text))), lambda x: x[text])
    texts = found.groupBy("query_id").agg(F.trim(F.array_join(parts, "\n\n")).alias("text"))
    if queries is None:
        return texts
    return queries.select("query_id").distinct().join(texts, "query_id", "left").withColumn("text", F.coalesce("text", F.lit(NO_CHUNK)))


def classify(queries: DataFrame, index: DataFrame, label: str = "label", k: int = 1) -> DataFrame:
    """`query_id, label`: that of the nearest entry; of k nearest the most frequent, the nearest of equals."""
    hits = top_k(queries, index, k).join(index.select("index", label), "index")
    votes = hits.groupBy("query_id", label).agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    return votes.groupBy("query_id").agg(F.max_by(label, F.struct("n", (-F.col("r")).alias("r"))).alias(label))

"""Extractive and recursive summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_sentences, word_count
from ..functions.vectors import cosine
from ..session import cut_lineage

KEEP, MIN_WORDS, MAX_WORDS, TOPIC, MIN_CHUNK, LONG, DEPTH = 0.4, 256, 768, 0.7, 20, 1024, 4


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id, pos, sentence` of each document."""
    return docs.select("doc_id", F.posexplode(split_sentences(F.col(text))).alias("pos", "sentence"))


def centroid(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The mean vector of each group: one partially aggregated row per group and dimension."""
    long = rows.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def extractive_filter(rows: DataFrame, keys: list[str], order: str, vector: str = "embedding", keep: float = KEEP) -> DataFrame:
    """Of groups of more than 3 rows the share `keep` (1 at least) nearest to the mean vector, the earlier of equals."""
    group = Window.partitionBy(*keys)
    rated = rows.join(centroid(rows, keys, vector), keys).withColumn("__sim", F.round(cosine(F.col(vector), F.col("centroid")), 6)).drop("centroid")
    rated = rated.withColumn("__n", F.count("*").over(group)).withColumn("__r", F.row_number().over(group.orderBy(F.desc("__sim"), order)))
    return rated.where((F.col("__n") <= 3) | (F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * keep)))).drop("__n", "__r").withColumnRenamed("__sim", "similarity")


def _begins(length: int, words: int, similar: float, least: int = MIN_WORDS, most: int = MAX_WORDS, topic: float = TOPIC) -> bool:
    """Whether a row of so many words, so similar to the one before, begins a new group after one of this length."""
    return length + words > most or (length >= least and similar < topic)


def semantic_groups(rows: DataFrame, keys: list[str], order: str, words: str = "wc", vector: str = "embedding", least: int = MIN_WORDS, most: int = MAX_WORDS, topic: float = TOPIC) -> DataFrame:
    """`keys, order, grp`: a new group begins where it would get too long, or is long enough and the topic changes.

    The running length is reset as groups begin, which no window expresses: it is folded over each group's
    words and similarities to the row before, which pass by in order; no group is held.
    """
    before = F.lag(vector).over(Window.partitionBy(*keys).orderBy(order))
    rated = rows.withColumn("__sim", F.coalesce(F.round(cosine(before, F.col(vector)), 6), F.lit(1.0)))
    ordered = rated.select(*keys, F.col(order).cast("long").alias(order), F.col(words).cast("long").alias("__w"), "__sim").repartition(*keys).sortWithinPartitions(*keys, order)
    schema = ordered.select(*keys, order).schema.add("grp", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, length, group = None, 0, 0
        for batch in batches:
            numbers = []
            for *key, w, sim in zip(*(batch.column(c).to_pylist() for c in (*keys, "__w", "__sim")), strict=True):
                w = w or 0
                if group == 0 or key != now:
                    now, length, group = key, w, 1
                elif _begins(length, w, sim, least, most, topic):
                    length, group = w, group + 1
                else:
                    length += w
                numbers.append(group)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, order)), pa.array(numbers, pa.int32())], schema.names)

    return ordered.mapInArrow(run, schema)


def lead_summary(text: Column, count: int = 3) -> Column:
    """The stand-in summariser: the first sentences."""
    return F.array_join(F.slice(split_sentences(text), 1, count), " ")


def _text_starts(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[pa.Table]:
    """Rows of whole texts: each text's rows stand together in one partition, and the first has no number or 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        firsts = np.flatnonzero(pc.fill_null(batch.column(number), 0).to_numpy(zero_copy_only=False) == 0)
        if not len(firsts):
            held.append(batch)
            continue
        last = int(firsts[-1])
        whole = pa.Table.from_batches([*held, batch.slice(0, last)])
        if whole.num_rows:
            yield whole
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _central(similar: np.ndarray, text: np.ndarray, count: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """The rows that `extractive_filter` keeps, for rows in order of their texts and places."""
    order = np.lexsort((np.arange(len(text)), -np.where(np.isnan(similar), -np.inf, similar), text))
    rank = np.empty(len(text), int)
    rank[order] = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return np.flatnonzero((rank < np.maximum(1, np.floor(count * keep)).astype(int)[text]) | (count[text] <= 3))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A row of numbers for each vector, of NaN where there is none."""
    sizes = pc.unique(pc.drop_null(pc.list_value_length(column))).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different sizes: {sorted(sizes)}")
    there = pc.is_valid(column).to_numpy()
    out = np.full((len(there), sizes[0] if sizes else 0), np.nan)
    out[there] = pc.list_flatten(column).to_numpy().reshape(int(there.sum()), out.shape[1])
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of one and the other, to 6 places; NaN where one has no length."""
    along = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    return np.round(np.einsum("ij,ij->i", a, b) / np.where(along == 0, np.nan, along), 6)


def central_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, part, content` from `keys, pos, sentence, embedding`: the texts of `semantic_groups` over what `extractive_filter` keeps of each
    text, those of `MIN_CHUNK` words or more; a text without any has one row without content.

    The rows of a text stand together and in order, as exploding it leaves them, so nothing is shuffled or sorted; a task
    holds one batch and one text's sentences with their vectors.
    """
    schema = rows.select(*keys).schema.add("part", "integer").add("content", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _text_starts(batches, "pos"):
            starts = np.flatnonzero(pc.fill_null(own.column("pos"), 0).to_numpy() == 0)
            count = np.diff([*starts, own.num_rows])
            text = np.repeat(np.arange(len(starts)), count)
            vectors = _vectors(own.column("embedding"))
            known = np.add.reduceat(~np.isnan(vectors[:, :1]).any(1), starts, dtype=int)
            mean = np.add.reduceat(np.nan_to_num(vectors), starts) / np.maximum(known, 1)[:, None]
            kept = _central(_cosine(vectors, mean[text]), text, count)
            kept_text, sentences = text[kept].tolist(), own.column("sentence").take(pa.array(kept)).to_pylist()
            similar = np.nan_to_num(_cosine(vectors[kept[:-1]], vectors[kept[1:]]), nan=1.0).tolist()
            found: list[tuple[int, int, str | None]] = []
            now, length, held = -1, 0, []
            # each text has a row of its own at least, so the last group is closed by the end of the rows
            for k, (t, sentence) in enumerate(zip([*kept_text, -1], [*sentences, None], strict=True)):
                w = len((sentence or "").split())
                if t != now or _begins(length, w, similar[k - 1]):
                    if length >= MIN_CHUNK:
                        found.append((now, found[-1][1] + 1 if found and found[-1][0] == now else 0, " ".join(held)))
                    elif t != now and now >= 0 and (not found or found[-1][0] != now):
                        found.append((now, 0, None))
                    now, length, held = t, 0, []
                length += w
                held.append(sentence or "")
            at, part, content = zip(*found, strict=True)
            first = pa.array(starts[list(at)])
            columns = [*(own.column(c).take(first) for c in keys), pa.array(part, pa.int32()), pa.array(content, pa.string())]
            yield from pa.Table.from_arrays(columns, schema.names).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, summary_text` from `keys, part, s`: each text's summaries, none empty, joined by line breaks; its rows stand together."""
    schema = rows.select(*keys).schema.add("summary_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _text_starts(batches, "part"):
            starts = np.flatnonzero(own.column("part").to_numpy() == 0)
            said = own.column("s").to_pylist()
            whole = ["\n".join(filter(None, said[a:b])) for a, b in zip(starts, [*starts[1:], own.num_rows], strict=True)]
            yield from pa.Table.from_arrays([*(own.column(c).take(pa.array(starts)) for c in keys), pa.array(whole, pa.string())], schema.names).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def summarize(docs: DataFrame, encode: Callable[[Column], Column], summary: Callable[[Column], Column] = lead_summary, depth: int = DEPTH) -> DataFrame:
    """`doc_id, summary_text, original_words, summary_words, compression_ratio`.

    A text below 256 words is summarised at once; a longer one by groups of its central sentences, those of 20 words or more,
    joined by line breaks, and again while over 1,024 words are left and the depth allows. A
    document leaves the loop, of at most `depth` + 1 rounds, when it is done.

    Texts are dealt out once, as a file's rows may all be one task's; from there on a text's sentences, groups and summaries stay where it is.
    """
    todo = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id").withColumn("words", word_count(F.col("text")))
    todo = todo.withColumn("original_words", F.col("words"))
    keys = ["doc_id", "original_words"]
    done = None
    for level in range(depth + 1):
        short = todo.where(F.col("words") < MIN_WORDS).select(*keys, summary(F.col("text")).alias("summary_text"), F.lit(False).alias("long"))
        rows = todo.where(F.col("words") >= MIN_WORDS).select(*keys, F.posexplode_outer(split_sentences(F.col("text"))).alias("pos", "sentence"))
        parts = central_parts(rows.withColumn("embedding", encode(F.col("sentence"))), keys).withColumn("s", summary(F.col("content"))).drop("content")
        every = short.unionByName(_joined(parts, keys).withColumn("long", F.lit(True)))
        # written once a round: what is ready and what goes on are both read from it
        merged = cut_lineage(every.withColumn("words", word_count(F.col("summary_text"))))
        again = F.col("long") & (F.col("words") > LONG) & F.lit(level < depth)
        ready = merged.where(~again).select(*keys, "summary_text", "words")
        done = ready if done is None else done.unionByName(ready)
        if level == depth:
            break
        todo = merged.where(again).select("doc_id", F.col("summary_text").alias("text"), "words", "original_words")
        if todo.limit(1).count() == 0:
            break
    ratio = F.when(F.col("original_words") > 0, F.round(F.col("words") / F.col("original_words"), 3)).otherwise(0.0)
    return done.select("doc_id", "summary_text", F.col("original_words").cast("long").alias("original_words"), F.col("words").cast("long").alias("summary_words"), ratio.alias("compression_ratio"))

"""The engine: one method for each step of the pipeline, with pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, index, latent, layout, nested, paragraphs, quality, search, structure, summarize
from ..operators.coverage import coverage_summary
from ..sources import readers, writers


def hashed_encoder(dimensions: int = 64) -> Callable[[Column], Column]:
    """The stand-in encoder: words hashed into a signed vector of unit length; equal on every machine. It stands in for a
    sentence encoder where none can be loaded, and knows nothing of meaning."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        class Places(dict[str, int]):
            """A word's place, and beyond the dimensions if its sign is negative."""

            def __missing__(self, w: str) -> int:
                h = zlib.crc32(w.encode())
                self[w] = place = h % dimensions + (0 if h >> 16 & 1 else dimensions)
                return place

        places = Places()
        for texts in batches:
            found, sizes = [], []
            for t in texts:
                if len(places) >= 1 << 16:  # a worker's memory of words is bounded
                    places.clear()
                own = [places[w] for w in (t or "").lower().split()]
                found += own
                sizes.append(len(own))
            at = np.repeat(np.arange(len(sizes)) * (2 * dimensions), sizes) + np.array(found, int)
            counts = np.bincount(at, minlength=len(sizes) * 2 * dimensions).reshape(len(sizes), 2, dimensions)
            v = (counts[:, 0] - counts[:, 1]).astype(float)
            length = np.sqrt((v * v).sum(1, keepdims=True))
            yield pd.Series(list(v / np.where(length == 0, 1.0, length)))

    return encode


@dataclass
class Engine:
    """Encoder, pair scorer and summariser are columns to columns; the defaults run offline."""

    encode: Callable[[Column], Column] = field(default_factory=hashed_encoder)
    score: Callable[[Column, Column], Column] = search.overlap_score
    summary: Callable[[Column], Column] = field(default_factory=coverage_summary)

    @classmethod
    def learned(cls, docs: DataFrame, text: str = "text", **parameters: int) -> Engine:
        """An engine whose encoder has learned from the texts of `docs`; `parameters` as `operators.latent.learn` takes them."""
        return cls(encode=latent.learn(docs, text, **parameters).encoder())

    def check(self, pages: DataFrame) -> DataFrame:
        return quality.quality_gate(pages)

    def extract(self, spans: DataFrame, pages: DataFrame | None = None) -> DataFrame:
        return layout.extract(spans, pages)

    def paragraphs(self, spans: DataFrame) -> DataFrame:
        return paragraphs.merge(layout.extract(spans))

    def levels(self, rows: DataFrame, max_depth: int | None = None) -> DataFrame:
        sequence = structure.marker_sequence(rows, layout.common_markers(rows, "Paragraph"))
        mined = structure.build_structures(sequence, ["doc_id"], ["pos"], "marker", max_depth)
        return structure.level_specs(structure.deduplicate(mined, ["doc_id"]))

    def chunks(self, rows: DataFrame, specs: DataFrame, levels: int) -> DataFrame:
        placed = chunks.assign_levels(rows, specs)
        return chunks.segment_filter(chunks.hierarchical_chunks(placed, levels, "Paragraph", "Text"))

    def schema(self, records: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
        return nested.infer_types(records, exclude=exclude)

    def index(self, records: DataFrame, id_col: str, schema: DataFrame | None = None) -> DataFrame:
        return index.build(records, id_col, schema, self.encode)

    def save(self, entries: DataFrame, records: DataFrame, folder: str) -> None:
        """The index bundle: entries with their vectors, and the records that they lead to."""
        writers.write_index(entries, f"{folder}/index")
        writers.write_index(records, f"{folder}/records")

    def load(self, spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
        return readers.read_index(spark, f"{folder}/index"), readers.read_index(spark, f"{folder}/records")

    def search(self, queries: DataFrame, entries: DataFrame, k: int = search.TOP_K, rerank_k: int = search.RERANK_K) -> DataFrame:
        """Hits for `query_id, query`."""
        asked = queries.select("query_id", self.encode(F.col("query")).alias("embedding"))
        hits = search.with_entries(search.top_k(asked, entries, k), entries)
        return search.rerank(hits, queries, rerank_k, self.score)

    def answer(self, hits: DataFrame, records: DataFrame, n: int | None = None) -> DataFrame:
        return search.lookup(search.first_chunks(hits, n, "new_rank"), records)

    def summarize(self, docs: DataFrame) -> DataFrame:
        return summarize.summarize(docs, self.encode, self.summary)

    def classify(self, docs: DataFrame, entries: DataFrame, records: DataFrame, field_name: str) -> DataFrame:
        """`query_id, labels`: the field of the best chunk for each summary, several joined by ", "."""
        hits = self.search(docs, entries)
        found = self.answer(hits, records, 1).groupBy("query_id")
        return found.agg(F.array_join(F.array_sort(F.collect_set(field_name)), ", ").alias("labels"))

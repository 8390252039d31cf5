"""An encoder learned from the corpus: latent semantic directions of a weighted term matrix, by randomised subspace iteration
(after Halko, Martinsson and Tropp, 2011).

Words fall into a fixed number of hashed cells, so every matrix on the driver and in a broadcast has a size that parameters set: cells
times directions. Each pass multiplies the rows of a partition with what is known so far and sums the products in the partition; sums are
added in a shuffle by blocks of cells. The small core that remains is solved on the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cuts, drop_cuts

#: Cells that words are hashed into, directions that are kept, more that are carried along, and passes over the corpus.
CELLS, DIRECTIONS, EXTRA, PASSES = 1 << 14, 64, 16, 2
#: Cells of a block of sums; rows of a multiplication.
_BLOCK, _ROWS = 1 << 10, 1024
_SEED = 5
_WORD = re.compile(r"[^\W_]+")


def cells_of(text: str, cells: int) -> dict[int, float]:
    """The cells of a text's words, each with 1 + log of how many there are."""
    counted = Counter(zlib.crc32(w.encode()) % cells for w in _WORD.findall(text.lower()))
    return {c: 1.0 + float(np.log(n)) for c, n in counted.items()}


def hashed(docs: DataFrame, text: str = "text", cells: int = CELLS) -> DataFrame:
    """`cell, weight` arrays, a row for each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cells_of(t, cells) for t in batch.column(0).to_pylist() if t]
            found = [f for f in found if f]
            yield pa.RecordBatch.from_arrays([pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float64()))], ["cell", "weight"])

    return docs.select(text).mapInArrow(run, "cell array<int>, weight array<double>")


def _weighted(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the term matrix, some at a time: weights times the cells' rarity, of unit length."""
    cell, weight = (batch.column(c) for c in ("cell", "weight"))
    for at in range(0, batch.num_rows, _ROWS):
        own = cell.slice(at, _ROWS)
        n = own.value_lengths().to_numpy()
        a = np.zeros((len(n), len(idf)))
        a[np.repeat(np.arange(len(n)), n), own.flatten().to_numpy()] = weight.slice(at, _ROWS).flatten().to_numpy()
        a *= idf
        yield a / np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-12)


def _added(rows: DataFrame, idf: np.ndarray, basis: np.ndarray, core: bool) -> np.ndarray:
    """Over all rows a of the matrix the sum of a^T (a basis), or, for the `core`, of (a basis)^T (a basis). Blocks are added in
    order of partitions, so a repeated task changes no digit."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, basis))  # cells x directions
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf, basis = shared.value
        held = np.zeros((width if core else len(idf), width))
        for batch in batches:
            for a in _weighted(batch, idf):
                y = a @ basis
                held += (y if core else a).T @ y
        blocks = [held[at : at + _BLOCK].tobytes() for at in range(0, len(held), _BLOCK)]
        part = np.full(len(blocks), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(part), pa.array(blocks, pa.binary())], ["block", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()], pa.binary())], ["block", "sums"])
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield out()
                    now, held = block, np.zeros(len(sums) // 8)
                held += np.frombuffer(sums)
        if now is not None:
            yield out()

    parts = rows.mapInArrow(run, "block long, part long, sums binary").repartition("block").sortWithinPartitions("block", "part")
    found = parts.mapInArrow(add, "block long, sums binary").toArrow().sort_by("block")
    return np.frombuffer(b"".join(found["sums"].to_pylist())).reshape(-1, width)


@dataclass
class Latent:
    """`projection`: a row of directions for each cell, with the cell's rarity in it; `strength`: singular values."""

    projection: np.ndarray
    strength: np.ndarray

    def vector(self, text: str | None) -> np.ndarray:
        found = cells_of(text or "", len(self.projection))
        v = np.fromiter(found.values(), float, len(found)) @ self.projection[list(found)] if found else np.zeros(self.projection.shape[1])
        return v / (np.sqrt(v @ v) or 1.0)

    def encoder(self) -> Callable[[Column], Column]:
        """A column of texts to one of unit vectors, as the engine takes it; a text without words has zeros."""
        own = self

        @F.pandas_udf("array<double>")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series([own.vector(t) for t in texts])

        return encode


def learn(docs: DataFrame, text: str = "text", directions: int = DIRECTIONS, cells: int = CELLS, extra: int = EXTRA, passes: int = PASSES) -> Latent:
    """The strongest `directions` of the texts of `docs`; fewer if the texts have fewer. Null texts and texts without words have no
    part; without any, every vector is zeros."""
    spark, begun = docs.sparkSession, cuts()
    rows = cut_lineage(hashed(docs, text, cells))
    n = rows.count()
    seen = rows.select(F.explode("cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # `cells` rows at most
    df = np.zeros(cells)
    df[seen["cell"].to_numpy()] = seen["n"].to_numpy()
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    if not n:
        return Latent(np.zeros((cells, directions)), np.zeros(directions))
    basis = np.random.default_rng(_SEED).normal(size=(cells, min(directions + extra, cells)))
    for _ in range(max(passes, 1)):
        basis = np.linalg.qr(_added(rows, idf, basis, core=False))[0]
    power, turn = np.linalg.eigh(_added(rows, idf, basis, core=True))
    order = np.argsort(power)[::-1][:directions]
    strength = np.sqrt(np.maximum(power[order], 0))
    order, strength = order[strength > 1e-9], strength[strength > 1e-9]
    drop_cuts(spark, begun, keep=0)
    return Latent(idf[:, None] * (basis @ turn[:, order]), strength)

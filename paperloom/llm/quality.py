"""Text quality by kernel ridge regression on document statistics, calibrated to probabilities.

Statistics of every text (lengths, shares of kinds of characters and words, repetition of words, word pairs and lines) are
computed once, vectorised, and written: some hundred bytes a document, from which all later steps read. Random Fourier features of
the standardised statistics stand in for a Gaussian kernel. Every partition of the labelled rows sums its own normal
equations, by fold; the sums are added in a shuffle by matrix row, and only the totals, whose size the number of features sets, reach the driver, which
solves them. Scores that each fold got from the others' equations are counted in fixed cells and made monotone by pooling adjacent violators; that
curve turns a score into a probability.

All labelled rows outside the held-out part train; there is no sample. Null and empty texts have statistics like others (zeros).
Repeated rows each count and each get a row. Repeated labels of a document count once, the least; null labels don't count.
Without training rows every score is 0.5. Columns of the tables beside those named have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, made, written
from .textkernel import Words, byte_class, mix, slices, utf8, xxh64

#: Random features, folds of the cross-fit, width of the kernel over the root of the number of statistics, and
#: the penalties (a share of the rows) of which the one with the least cross-fitted error is taken.
FEATURES, FOLDS, WIDTH = 256, 4, 1.0
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2)
#: Standardised statistics are held in this range; raw scores are counted in cells of this size.
_MOST, _CELL = 5.0, 1 / 1024
_SEED = 11


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


# --- statistics

_ALL = np.arange(256)
_UPPER, _LOWER = (_ALL >= 65) & (_ALL <= 90), (_ALL >= 97) & (_ALL <= 122)
_LETTER = _UPPER | _LOWER | (_ALL >= 128)
_DIGIT = (_ALL >= 48) & (_ALL <= 57)
_SPACE = (_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13))
_STOP, _EXCLAIM = np.isin(_ALL, list(b".,;:")), np.isin(_ALL, list(b"!?"))
_SYMBOL = (_ALL > 32) & ~(_LETTER | _DIGIT | _STOP | _EXCLAIM | np.isin(_ALL, list(b"'\"()-"))) & (_ALL < 127)
_LINES = byte_class([(0x0A, 0x0D)])
_FULL = np.isin(_ALL, list(b".!?"))

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "letters", "upper", "digits", "symbols", "exclamations", "stops",
    "bare_words", "symbol_ends", "exclaimed_words", "capital_words", "capitalised_words", "repeated_next", "distinct_words", "top_word",
    "distinct_pairs", "log_lines", "line_words", "repeated_lines", "full_lines",
)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _kinds(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row (fewer than 2**23) how many kinds of values it has, and how often the most frequent occurs; 40 bits of
    a value tell kinds apart, which is enough for a share."""
    key = np.sort((row << 40) | (value >> np.uint64(24)).astype(np.int64))
    start = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    of, n = key[start] >> 40, np.diff(np.append(start, len(key)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, of, n)
    return np.bincount(of, minlength=rows), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of `STATISTICS` for each text."""
    rows = len(offsets) - 1

    def sums(table: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(table[data])])

    words = Words(data, offsets, lower=False)
    lines = Words(data, offsets, _LINES, lower=False)
    n, m = words.counts, lines.counts
    of = np.repeat(np.arange(rows), n)
    size = words.end - words.start
    total = lambda x: np.bincount(of, x, minlength=rows)
    upper, lower, letter, digit = sums(_UPPER), sums(_LOWER), sums(_LETTER), sums(_DIGIT)
    text = lambda s: np.diff(s[offsets])
    word = lambda s: s[words.end] - s[words.start]
    chars = text(sums((_ALL & 0xC0) != 0x80))
    visible = np.maximum(np.diff(offsets) - text(sums(_SPACE)), 1)
    ends = data[words.end - 1]
    hashes = mix(xxh64(data, words.start, words.end))
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    paired = np.flatnonzero(of[1:] == of[:-1])
    with np.errstate(over="ignore"):
        pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[paired] if len(words) else hashes
    kinds, top = _kinds(of, hashes, rows)
    pair_kinds, _ = _kinds(of[paired], pairs, rows)
    at = np.repeat(np.arange(rows), m)
    line_kinds, _ = _kinds(at, xxh64(data, lines.start, lines.end), rows)
    mean = _share(total(size), n)
    spread = np.sqrt(np.maximum(_share(total(size.astype(float) ** 2), n) - mean**2, 0))
    capital = (word(upper) >= 2) & (word(lower) == 0)
    root = lambda x: np.sqrt(_share(x, n))
    return np.stack([
        np.log1p(chars), np.log1p(n), np.log1p(mean), spread / (1 + mean), text(letter) / visible, np.sqrt(_share(text(upper), text(upper) + text(lower))),
        np.sqrt(text(digit) / visible), np.sqrt(text(sums(_SYMBOL)) / visible), root(text(sums(_EXCLAIM))), root(text(sums(_STOP))),
        root(total(word(letter) + word(digit) == 0)), root(total(_SYMBOL[ends])), root(total(_EXCLAIM[ends])), root(total(capital)),
        root(total(_UPPER[data[words.start]])), root(total(same)), _share(kinds, n), root(top),
        _share(pair_kinds, n), np.log1p(m), np.log1p(_share(n, m)), np.sqrt(1 - _share(line_kinds, m)), _share(np.bincount(at, _FULL[data[lines.end - 1]], minlength=rows), m),
    ], 1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """`doc_id, stats` per row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = statistics(*utf8(part.column("text"))).astype(np.float32)
                stats = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), stats], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(float)


# --- sums of partitions


def _summed(rows: DataFrame, width: int, parts: int, terms) -> np.ndarray:  # noqa: ANN001
    """The sum over all rows of `parts` matrices of `width` columns: `terms(batch)` gives a batch's. Each partition
    sums its own, and matrix rows are added in order of partitions, so that a repeated task changes no digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            if batch.num_rows:
                held = terms(batch) if held is None else held + terms(batch)
        if held is not None:
            flat = held.reshape(-1, width)
            values = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, width, dtype=np.int32), pa.array(flat.ravel()))
            part = np.full(len(flat), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(part), values], ["row", "part", "values"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tolist()])], ["row", "values"])
        for batch in batches:
            for row, values in zip(batch.column("row").to_pylist(), _matrix(batch.column("values")) if batch.num_rows else (), strict=True):
                if row == now:
                    held = held + values
                    continue
                if now is not None:
                    yield out()
                now, held = row, values
        if now is not None:
            yield out()

    sums = rows.mapInArrow(run, "row long, part long, values array<double>")
    sums = sums.repartition("row").sortWithinPartitions("row", "part").mapInArrow(add, "row long, values array<double>").toArrow().sort_by("row")
    if not sums.num_rows:
        return np.zeros((parts, 0, width))
    return _matrix(sums["values"].combine_chunks()).reshape(parts, -1, width)


# --- model


@dataclass
class Model:
    """`weights` has a column for the whole and one without each fold; `curve` the raw scores and probabilities between
    which is interpolated."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))
    features: int = FEATURES
    width: float = WIDTH

    def __post_init__(self) -> None:
        rng = np.random.default_rng(_SEED)
        d = len(self.mean)
        self._turns = rng.normal(0, 1 / (self.width * np.sqrt(d)), (d, self.features))
        self._shifts = rng.uniform(0, 2 * np.pi, self.features)

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a one."""
        z = np.clip((x - self.mean) / self.scale, -_MOST, _MOST)
        return np.c_[np.cos(z @ self._turns + self._shifts) * np.sqrt(2 / self.features), np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.expand(x) @ self.weights[:, 0], *self.curve), 0, 1)


def solved(gram: np.ndarray, penalties: tuple[float, ...] = PENALTIES) -> np.ndarray:
    """Ridge weights from augmented normal equations by fold (folds, k + 1, k + 1; the label last): of all rows, then
    without each fold, with the penalty of least cross-fitted error. The one feature isn't penalised."""
    whole = gram.sum(0)

    def ridge(g: np.ndarray, penalty: float) -> np.ndarray:
        k = len(g) - 1
        bare = np.eye(k)
        bare[-1, -1] = 0
        n = g[k - 1, k - 1]
        return np.linalg.lstsq(g[:k, :k] + penalty * max(n, 1) * bare, g[:k, k], rcond=None)[0]

    def error(g: np.ndarray, w: np.ndarray) -> float:
        v = np.append(w, -1.0)
        return float(v @ g @ v)

    tried = []
    for penalty in penalties:
        without = [ridge(whole - g, penalty) for g in gram]
        tried.append((sum(error(g, w) for g, w in zip(gram, without, strict=True)), penalty, without))
    _, penalty, without = min(tried, key=lambda t: t[0])
    return np.stack([ridge(whole, penalty), *without], 1)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: of `total` ones in `n` rows at increasing `x`, the pools' mean places and shares."""
    pools: list[list[float]] = []
    for place, ones, rows in zip(x.tolist(), total.tolist(), n.tolist(), strict=True):
        pools.append([place * rows, ones, rows])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    a = np.array(pools)
    return a[:, 0] / a[:, 2], a[:, 1] / a[:, 2]


def train(stats: DataFrame, labels: DataFrame, features: int = FEATURES, folds: int = FOLDS, width: float = WIDTH) -> Model:
    """A model of all rows of `stats` (doc_id, stats) that are labelled and not held out."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(_SEED)), F.lit(folds)).cast("int").alias("fold")
    rows = written(stats.join(known.where(~held_out()), "doc_id").select("stats", (F.col("y") > 0).cast("int").alias("y"), fold), "quality-rows")
    d = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("stats"))
        return np.stack([x.sum(0), (x * x).sum(0), np.full(d, float(len(x)))])

    sums = _summed(rows, d, 3, moments)
    if not sums.size:
        return Model(np.zeros(d), np.ones(d))
    mean = sums[0, 0] / sums[2, 0]
    spread = np.sqrt(np.maximum(sums[1, 0] / sums[2, 0] - mean**2, 0))
    model = Model(mean, np.maximum(spread, 1e-3), features=features, width=width)

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        a = np.c_[model.expand(_matrix(batch.column("stats"))), batch.column("y").to_numpy()]
        of = batch.column("fold").to_numpy()
        return np.stack([a[of == f].T @ a[of == f] for f in range(folds)])

    model.weights = solved(_summed(rows, features + 2, folds, equations))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = (model.expand(_matrix(batch.column("stats"))) @ model.weights)[np.arange(batch.num_rows), 1 + batch.column("fold").to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, -1, 2) / _CELL).astype(np.int64)), batch.column("y")], ["cell", "y"])

    counted = rows.mapInArrow(cells, "cell long, y int").groupBy("cell").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).toArrow().sort_by("cell")
    cell, ones, n = (counted[c].to_numpy() for c in ("cell", "ones", "n"))
    model.curve = isotonic((cell + 0.5) * _CELL, ones, n)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score` per row of `stats`."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # weights and a curve of 3 / _CELL points at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_matrix(batch.column("stats"))))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """`doc_id, held_out, score, predicted` per row of `docs` (doc_id, text): `score` is the probability that quality is 1."""
    begun = made()
    stats = written(with_statistics(docs), "quality-statistics")
    model = train(stats, labels)
    discard(docs.sparkSession, begun, keep=0, but=("quality-statistics",))
    return scored(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

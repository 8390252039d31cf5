"""Toxicity by compression distance.

Two zstandard dictionaries are trained on separate text: one on windows of ordinary documents, one on
the regions of toxic documents that set them apart: word beginnings whose document frequency differs most
between the classes, as often and in such company as the toxic documents have them. (Trained on whole toxic
documents, the second would fill with the ordinary words that they mostly consist of.) The ordinary
compressor has the first dictionary, the toxic one has both, with the ordinary text in the same place; so a window
that holds nothing toxic compresses to the same length with either, and the bytes saved are its gain.

A window is a word between spaces, so equal windows are compressed once. Lengths become evidence by thresholds
calibrated on gains that other documents' dictionaries gave (three folds of the sample), and a logistic
model over a document's evidence gives its score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, spread_text
from .textkernel import tidy

#: Bounds of the training sample: labelled rows, those of least hash, and code points of each; of a longer text,
#: sixteen pieces from all over it train.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 32768
#: Sizes of the dictionaries, and words of the windows that train the ordinary one.
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
_WINDOW = 4
#: Ordinary windows of a document that train the ordinary dictionary.
_PER_DOCUMENT = 6
#: Likelihood-ratio statistic from which a word's beginning counts as toxic.
_SIGNIFICANT = 25.0
#: Folds of the sample whose gains calibrate, each with a dictionary of the others.
_FOLDS = 3
_LOW, _HIGH, _LONGEST = -3, 9, 15
_GAINS = _HIGH - _LOW + 1
#: The cell of a window that neither compressor shortens; texts without words have one such window.
_NEUTRAL = -_LOW
_PAD = 64
#: Distinct windows whose lengths a worker remembers.
_MEMO = 1 << 17
_WORD = re.compile(r"[^\W\d_]+")


def held_out(modulus: int = 5, remainder: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


# --- regions that set toxic texts apart


def _beginnings(word: str) -> list[str]:
    """Beginnings of a word, and the whole word marked by a space at its end."""
    out = [word[:k] for k in range(4, min(len(word), 11) + 1)]
    if 3 <= len(word) <= 13:
        out.append(word + " ")
    return out


def _stems(found: list[str], known: dict[str, list[str]]) -> set[str]:
    """The stems of a text's words; `known` remembers those of each word."""
    return {s for word in set(found) for s in (known.get(word) or known.setdefault(word, _beginnings(word)))}


def _significant(inside: Counter, outside: Counter, toxic: int, ordinary: int) -> list[str]:
    """The stems significantly more frequent in toxic texts by document, the most significant first."""
    share = toxic / max(toxic + ordinary, 1)
    found: list[tuple[float, str]] = []
    for s, a in inside.items():
        b = outside[s]
        expected = (a + b) * share
        if a >= 4 and a > expected:
            value = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0))
            if value >= _SIGNIFICANT:
                found.append((value, s))
    return [s for _, s in sorted(found, reverse=True)]


def toxic_stems(toxic: list[str], ordinary: list[str]) -> list[str]:
    inside = Counter(s for t in toxic for s in _stems(words(t), {}))
    outside = Counter(s for t in ordinary for s in _stems(words(t), {}) if s in inside)
    return _significant(inside, outside, len(toxic), len(ordinary))


def _regions(found: list[str], rank: dict[str, int]) -> bytes:
    """Of each word of a toxic text that sets it apart, the beginning that does so most."""
    out = []
    for word in found:
        if known := [s for s in _beginnings(word) if s in rank]:
            out.append(" " + min(known, key=rank.__getitem__))
    # the trainer counts no fragment in the last bytes of a sample
    return ("".join(out) + " " * 8).encode() if out else b""


def _without_near_copies(texts: list[list[str]]) -> list[int]:
    """The texts, as words, of which at most half the word triples were in an earlier one."""
    seen: set[int] = set()
    out: list[int] = []
    for i, w in enumerate(texts):
        triples = set(map(hash, zip(w, w[1:], w[2:], strict=False)))
        if len(triples & seen) <= 0.5 * len(triples):
            seen |= triples
            out.append(i)
    return out


# --- compression


def _trained(size: int, samples: list[bytes], **parameters: int) -> bytes:
    """The content of a dictionary that zstandard trains; of samples too few for it, the samples."""
    try:
        whole = zstandard.train_dictionary(size, samples, d=6, **parameters).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    # fixed values: the three start offsets that end the header of a zstandard dictionary
    return whole[whole.index(b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00") + 12 :]


def _spread(found: list[str]) -> list[bytes]:
    """A few windows of several words from all over a text."""
    n = -(-len(found) // _WINDOW)
    cuts = np.linspace(0, n, min(n, _PER_DOCUMENT) + 1).astype(int).tolist()
    return [f" {' '.join(found[(a + b) // 2 * _WINDOW :][:_WINDOW])} ".encode() for a, b in pairwise(cuts)]


@dataclass
class Compressors:
    ordinary: bytes
    toxic: bytes

    def __post_init__(self) -> None:
        parameters = zstandard.ZstdCompressionParameters(
            compression_level=5, strategy=zstandard.STRATEGY_GREEDY, min_match=5, search_log=7, window_log=16, hash_log=14, chain_log=14,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

        self._plain, self._both = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        # a window that doesn't shrink would be stored as it is, so each gets an end that is known to shrink
        self._pad = self.ordinary[-_PAD:]
        self._memo: dict[str, int] = {}

    def __reduce__(self):  # noqa: ANN204
        return Compressors, (self.ordinary, self.toxic)

    def lengths(self, word: str) -> tuple[int, int]:
        """Of the window of a word, its compressed length without toxic text to refer to, and with it."""
        window = f" {word} ".encode() + self._pad
        return len(self._plain.compress(window)), len(self._both.compress(window))

    def cells(self, found: list[str]) -> np.ndarray:
        """For the window of each word its bytes, up to 15, and its gain, as one number."""
        memo = self._memo
        if len(memo) > _MEMO:
            memo.clear()
        for word in {w for w in found if w not in memo}:
            plain, both = self.lengths(word)
            memo[word] = min(len(word.encode()), _LONGEST) * _GAINS + min(max(plain - both, _LOW), _HIGH) - _LOW
        return np.fromiter((memo[w] for w in found), np.int64, len(found)) if found else np.array([_NEUTRAL])


@dataclass
class Model:
    compressors: Compressors | None
    evidence: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, cells: np.ndarray) -> list[float]:
        e = self.evidence[cells]
        n = len(e)
        top = np.append(np.sort(e[e > 0])[::-1][:4], np.zeros(4))
        return [
            math.log1p(e[e > 0.5].sum()), top[0], top[1], top[:4].sum(), math.log1p((e > 1).sum()), math.log1p((e > 2).sum()),
            math.sqrt((e > 1).mean()), math.log(n), e.sum() / math.sqrt(n),
        ]

    def score(self, text: str) -> float:
        if self.compressors is None:
            return 0.0
        x = np.append((np.array(self.features(self.compressors.cells(words(text)))) - self.mean) / self.scale, 1.0)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, x @ self.weights)))))


def _evidence(cells: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each window's size and gain, drawn to that of the gain alone where few windows were seen."""
    shape = (2, _LONGEST + 1, _GAINS)
    seen = np.zeros(shape)
    for c, v in zip(cells, y, strict=True):
        seen[int(v)] += np.bincount(c, minlength=shape[1] * shape[2]).reshape(shape[1:])
    total = seen.sum((1, 2))
    by_gain = seen.sum(1) + 0.5
    ratio = (by_gain[1] / by_gain[1].sum()) / (by_gain[0] / by_gain[0].sum())
    prior = 4.0 / (1 + ratio)
    rate = (seen[1] * total[0] / max(total[1], 1) + prior * ratio) / (seen[0] + prior)
    return np.log(rate).ravel()


def _logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(len(w)), a.T @ (weight * (p - y)) + w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model of (text, toxic) rows; without rows of both classes that differ it scores 0. Equal texts count
    once, as toxic if any is, and near copies train no dictionary."""
    cells_ = (_LONGEST + 1) * _GAINS
    empty = Model(None, np.zeros(cells_), np.zeros(9), np.ones(9), np.zeros(10))
    known = dict(sorted((t, int(bool(y))) for t, y in rows))
    y = np.array(list(known.values()), float)
    fold = np.array([zlib.crc32(t.encode()) % _FOLDS for t in known], int)
    same: dict[str, str] = {}  # one string a distinct word
    texts = [[same.setdefault(w, w) for w in words(t)] for t in known]
    alone = [own[_without_near_copies([texts[i] for i in own])] for own in (np.flatnonzero(y == 0), np.flatnonzero(y))]
    # by class and fold, in how many documents a stem is; only stems of several toxic ones matter
    begins: dict[str, list[str]] = {}
    inside = [Counter(s for i in alone[1] if fold[i] == f for s in _stems(texts[i], begins)) for f in range(_FOLDS)]
    every = {s for s, n in sum(inside, Counter()).items() if n >= 4}
    begins = {w: [s for s in _beginnings(w) if s in every] or [""] for w in same}
    outside = [Counter(s for i in alone[0] if fold[i] == f for s in _stems(texts[i], begins)) for f in range(_FOLDS)]
    samples = [w for i in alone[0] for w in _spread(texts[i])]
    if not every or sum(map(len, samples)) < 4 * ORDINARY_BYTES:
        return empty
    ordinary = _trained(ORDINARY_BYTES, samples, k=32)[-ORDINARY_BYTES:]

    def compressors(without: int | None) -> Compressors | None:
        use = [f for f in range(_FOLDS) if f != without]
        n = [sum(int((fold[alone[c]] == f).sum()) for f in use) for c in (0, 1)]
        stems = _significant(sum((inside[f] for f in use), Counter()), sum((outside[f] for f in use), Counter()), n[1], n[0])
        rank = {s: k for k, s in enumerate(stems)}
        regions = [r for i in alone[1] if fold[i] in use and (r := _regions(texts[i], rank))]
        return Compressors(ordinary, _trained(TOXIC_BYTES, regions, k=12)) if regions else None

    last = compressors(None)
    if last is None:
        return empty
    by_fold = [compressors(f) or last for f in range(_FOLDS)]
    cells = [by_fold[f].cells(t) for f, t in zip(fold, texts, strict=True)]
    model = Model(last, _evidence(cells, y), empty.mean, empty.scale, empty.weights)
    x = np.array([model.features(c) for c in cells])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    # half way from the classes' frequencies to equal ones
    weight = np.where(y > 0, math.sqrt((len(y) - y.sum()) / max(y.sum(), 1)), 1.0)
    model.weights = _logistic(np.c_[(x - model.mean) / model.scale, np.ones(len(x))], y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """`fit` on a bounded sample: of labelled documents outside the held-out fold, the `rows` of least hash. Of a text of
    more than `chars` code points, pieces from all over it are used. Repeated labels of a document count once, the largest."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("__toxic"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(2 * rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    # 2 x rows ids at most, 12 bytes each
    sample = texts.join(F.broadcast(known), "doc_id").select("doc_id", spread_text("text", chars).alias("text"), "__toxic")
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "text").limit(rows)
    model = fit([(r.text, int(r["__toxic"])) for r in sample.select("text", "__toxic").toLocalIterator()])
    tidy()  # the driver goes on without the sample
    return model


def scorer(docs: DataFrame, model: Model) -> Column:
    """The score of `text`, null or not; only the text passes to Python, and a number back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            yield pa.array([model.score(t.as_py() or "") for t in batch], pa.float64())
            tidy()

    # evaluated once, wherever the column is used
    return F.arrow_udf(run, "double").asNondeterministic()(F.col("text"))


def scores(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from `threshold` on) after its columns.

    Every text is scored whole; a null or wordless one scores as a text without gains. Columns of `docs`
    named like a result are replaced. Repeated rows each get a row.
    """
    rows = docs.drop("score", "predicted").withColumn("score", scorer(docs, model))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted` per row of `docs` (doc_id, text, any others); an empty table gives none.

    Of rows that share an id, each takes part in training if the id is labelled. Other columns, whatever
    their names, have no influence.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = scores(rows, train(docs, labels))
    return marked.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with their columns."""
    name = free_name(docs, "__toxic")
    return docs.withColumn(name, scorer(docs, train(docs, labels))).where(F.col(name) < threshold).drop(name)

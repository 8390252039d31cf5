"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; each language has its own piece probabilities,
learned by expectation-maximisation. A word's probability in a language is the sum over all its
segmentations into pieces, by the forward algorithm, which here runs over all distinct words of a run of
texts and all languages at once in NumPy. A text's score is the sum over its words. A word is a run of
letters of any length, as in scripts without spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, spread_text
from .textkernel import mix, slices, tidy, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
#: Bounds of the training sample: rows with a language, those of least hash, and code points of each; of a longer text,
#: sixteen pieces from all over it train.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 32768
ROUNDS = 4
#: Pseudo-count of a piece, and probability of a letter that no piece has.
_PSEUDO, _STRANGE = 0.05, 1e-8
#: Letters of a word up to which it is segmented together with others; longer words go one by one, and don't train.
_LETTERS = 32
#: Words up to which evidence adds up in the score.
_EVIDENCE = 30
_U = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)


def held_out(modulus: int = 5, remainder: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


@cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case where that is one code point."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            if len(low := s.lower()) == 1:
                lower[c] = ord(low)
    return letter, lower


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.concatenate([[_U(1)], np.cumprod(np.full(size, _U(_R)))])
        down = np.concatenate([[_U(1)], np.cumprod(np.full(size, _U(_RINV)))])
    return up, down


class Letters:
    """The words, runs of letters, of a run of texts, and their distinct ones."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, lower = _code_points()
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # offsets in code points
        inside = letter[points]
        points = lower[points]
        n = len(points)
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        before[at[at < n]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]]) if n else inside
        after[at[(at > 0)] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(start, at)
        size = 1 << max(int(n).bit_length(), 10)  # the powers are kept, 16 bytes each
        up, down = _powers(size)
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate([[_U(0)], np.cumsum((points.astype(np.uint64) + _U(1)) * up[:n])])
            self.down = down
            key = mix((self.prefix[end] - self.prefix[start]) * down[start])
        _, index, self.word = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.end = start[index], end[index]
        self.count = np.diff(self.first)

    def blocks(self) -> Iterator[np.ndarray]:
        """The distinct words of at most _LETTERS letters, some at a time."""
        short = np.flatnonzero(self.end - self.start <= _LETTERS)
        for at in range(0, len(short), _BLOCK):
            yield short[at : at + _BLOCK]

    def longer(self) -> np.ndarray:
        return np.flatnonzero(self.end - self.start > _LETTERS)

    def hashes(self, start: int, end: int, size: int) -> np.ndarray:
        """Of each run of `size` letters from `start` to `end`."""
        with np.errstate(over="ignore"):
            return (self.prefix[start + size : end + 1] - self.prefix[start : end + 1 - size]) * self.down[start : end + 1 - size]


def _table(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressing table of the pieces' hashes: slot -> hash, slot -> piece number (-1: free)."""
    size = 1 << max(4, (4 * len(pieces)).bit_length())
    hashes, numbers = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
    for i, piece in enumerate(pieces):
        h = 0
        for k, c in enumerate(piece):
            h = (h + (ord(c) + 1) * pow(_R, k, 1 << 64)) % (1 << 64)
        slot = int(mix(np.array([h], np.uint64))[0]) % size
        while numbers[slot] >= 0:
            slot = (slot + 1) % size
        hashes[slot], numbers[slot] = h, i
    return hashes, numbers


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    hashes, numbers = table
    mask = _U(len(hashes) - 1)
    slot = mix(h) & mask
    found = np.where(hashes[slot] == h, numbers[slot], -1)
    left = np.flatnonzero((found < 0) & (numbers[slot] >= 0))
    while len(left):
        slot[left] = (slot[left] + _U(1)) & mask
        s = slot[left]
        hit = (hashes[s] == h[left]) & (numbers[s] >= 0)
        found[left[hit]] = numbers[s[hit]]
        left = left[~hit & (numbers[s] >= 0)]
    return found


@dataclass
class Pieces:
    """The vocabulary: pieces inside a word, and those that begin one (marked by U+2581 in the file)."""

    inside: list[str]
    begin: list[str]
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.tables = _table(self.inside), _table(self.begin)
        self.longest = max(map(len, self.inside + self.begin), default=1)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        words = lambda found: sorted({p for p in found if p and p.isalpha() and p == p.lower()})
        return cls(words(p for p in every if p[:1] != "▁"), words(p[1:] for p in every if p[:1] == "▁"))

    def __len__(self) -> int:
        """Pieces, and last the bare word mark."""
        return len(self.inside) + len(self.begin) + 1


class Lattice:
    """Edges of the segmentations of distinct words, longest words first: for each end and length,
    the piece inside a word (-1: none), and from the word's start the piece that begins it."""

    def __init__(self, words: Letters, pieces: Pieces, chosen: np.ndarray):
        size = words.end[chosen] - words.start[chosen]
        self.order = chosen[np.argsort(-size, kind="stable")]
        self.size = -np.sort(-size, kind="stable")
        start = words.start[self.order]
        self.edges: list[tuple[int, int, int, np.ndarray, np.ndarray | None]] = []
        with np.errstate(over="ignore"):
            for j in range(1, int(self.size.max(initial=0)) + 1):
                n = int(np.searchsorted(-self.size, -j, side="right"))
                to = words.prefix[start[:n] + j]
                for s in range(max(0, j - pieces.longest), j):
                    h = (to - words.prefix[start[:n] + s]) * words.down[start[:n] + s]
                    self.edges.append((s, j, n, _find(pieces.tables[0], h), _find(pieces.tables[1], h) if s == 0 else None))
        self.offset = len(pieces.inside)

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        """alpha[j][word, language]: probability of the first j letters; p[piece, language] with a last row of zeros."""
        mark = p[-2]
        alpha = [np.tile(mark, (len(self.order), 1))]
        for s, j, n, inside, begin in self.edges:
            if len(alpha) <= j:
                alpha.append(np.zeros((n, p.shape[1])))
            alpha[j] += alpha[s][:n] * p[inside]
            if begin is not None:
                alpha[j] += p[np.where(begin < 0, -1, begin + self.offset)]
            if j == s + 1:
                strange = inside < 0
                alpha[j][strange] += alpha[s][:n][strange] * _STRANGE
        return alpha

    def totals(self, alpha: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(self.order), alpha[0].shape[1]))
        for j in range(1, len(alpha)):
            own = np.flatnonzero(self.size == j)
            out[own] = alpha[j][own]
        return out

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; counts[word, language]."""
        alpha = self.forward(p)
        weight = counts / self.totals(alpha)
        beta = [np.zeros((len(a), p.shape[1])) for a in alpha]
        for j in range(1, len(beta)):
            own = np.flatnonzero(self.size == j)
            beta[j][own] = 1.0
        uses = np.zeros_like(p)
        for s, j, n, inside, begin in reversed(self.edges):  # all edges into j come before those into j - 1
            b = beta[j][:n]
            beta[s][:n] += b * p[inside]
            np.add.at(uses, inside, alpha[s][:n] * p[inside] * b * weight[:n])
            if begin is not None:
                piece = np.where(begin < 0, -1, begin + self.offset)
                np.add.at(uses, piece, p[piece] * b * weight[:n])
            if j == s + 1:
                strange = np.flatnonzero(inside < 0)
                beta[s][strange] += b[strange] * _STRANGE
        uses[-2] = (beta[0] * p[-2] * weight).sum(0)
        uses[-1] = 0
        return uses


def long_word(words: Letters, pieces: Pieces, word: int, p: np.ndarray) -> np.ndarray:
    """Log probability of one word in each language, over all its segmentations. The forward state is that of the last
    letters, as many as a piece has at most, and is scaled at each letter, so a word may have any length."""
    start, end = int(words.start[word]), int(words.end[word])
    n, longest = end - start, min(pieces.longest, end - start)
    offset = len(pieces.inside)
    # by letter and length of the piece that ends there
    inside = np.full((n + 1, longest), -1, np.int32)
    for size in range(1, longest + 1):
        inside[size:, size - 1] = _find(pieces.tables[0], words.hashes(start, end, size))
    begin = [int(_find(pieces.tables[1], words.hashes(start, start + size, size))[0]) for size in range(1, longest + 1)]
    strange = inside[:, 0] < 0
    state = np.zeros((longest, p.shape[1]))  # of the last letters, the latest first
    state[0] = p[-2]
    log = np.zeros(p.shape[1])
    for j in range(1, n + 1):
        now = (state * p[inside[j]]).sum(0)
        if strange[j]:
            now = now + state[0] * _STRANGE
        if j <= longest and begin[j - 1] >= 0:
            now = now + p[begin[j - 1] + offset] / np.exp(log)
        state[1:] = state[:-1]
        state[0] = now
        scale = now + 1e-300
        state /= scale
        log += np.log(scale)
    return log


#: Distinct words that a lattice takes at once, and text bytes of a run.
_BLOCK, _RUN = 1 << 13, 1 << 20


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray  # [piece, language], then the word mark, then zeros

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text's words in each language, and how many words it has."""
        words = Letters(data, offsets)
        per = np.zeros((len(words.start), len(self.languages)))
        for block in words.blocks():
            lattice = Lattice(words, self.pieces, block)
            per[lattice.order] = np.log(np.maximum(lattice.totals(lattice.forward(self.p)), 1e-300))
        for word in words.longer():
            per[word] = long_word(words, self.pieces, word, self.p)
        out = np.zeros((len(words.count), len(self.languages)))
        full = np.flatnonzero(words.count)
        if len(full):
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(per[words.word, k], words.first[full])
        return out, words.count

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
        total, count = self.scores(data, offsets)
        best = total.argmax(1)
        # evidence grows with the text up to a point, as a text's words are no independent draws
        x = (total - total.max(1, keepdims=True)) * (np.minimum(count, _EVIDENCE) / np.maximum(count, 1))[:, None]
        sure = 1 / np.exp(x).sum(1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, count, strict=True)], np.where(count > 0, sure, 0.0)


def fit(rows: list[tuple[str, str]], pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """A model of (text, language) rows."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    languages = sorted({r[1] for r in rows})
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    p[-1] = 0
    if not languages:
        return Model(languages, pieces, p)
    # a run of texts at a time, so that what is held grows with the distinct words alone
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.large_string()), pa.array([languages.index(r[1]) for r in rows])], ["text", "lang"])
    runs: list[tuple[Letters, np.ndarray]] = []
    for part in slices(batch, "text", _RUN):
        words = Letters(*utf8(part.column("text")))
        counts = np.zeros((len(words.start), len(languages)))
        np.add.at(counts, (words.word, np.repeat(part.column("lang").to_numpy(), words.count)), 1.0)
        runs.append((words, counts))
    for _ in range(rounds):
        uses = np.zeros_like(p)
        for words, counts in runs:
            for block in words.blocks():
                lattice = Lattice(words, pieces, block)
                uses += lattice.expected(p, counts[lattice.order])
        uses[:-1] += _PSEUDO
        p = uses / uses.sum(0)
    return Model(languages, pieces, p)


def train(docs: DataFrame, vocabulary: str = VOCABULARY, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """`fit` on a bounded sample: of documents with a language, outside the held-out fold, the `rows` of least hash; equal
    ids go by text. Of a text of more than `chars` code points, pieces from all over it are used."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(rows)
    # `rows` ids at most, 8 bytes each
    sample = known.join(F.broadcast(ids.distinct()), "doc_id").select("doc_id", spread_text("text", chars).alias("text"), "lang")
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id", "text").limit(rows)
    model = fit([(r.text, r.lang) for r in sample.select("text", "lang").toLocalIterator()], Pieces.load(vocabulary))
    _powers.cache_clear()
    tidy()  # the driver goes on without the sample
    return model


def predictor(docs: DataFrame, model: Model) -> Column:
    """The struct `lang, score` of `text`, null or not; only the text passes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            lang, score = [], []
            for part in slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text", _RUN):
                found = model.predict(*utf8(part.column("text")))
                lang += found[0]
                score.append(found[1])
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate([np.zeros(0), *score]))], ["lang", "score"])

    # evaluated once, wherever the column is used
    return F.arrow_udf(run, "lang string, score double").asNondeterministic()(F.col("text"))


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1) after its columns; only `text` is looked at.

    A null text or one without a letter is `und` with score 0, and so is every text if no language was learned. Equal scores
    go to the first language by name. The score is the language's share of the evidence, where a text of more than 30 words
    counts as one of 30 with the same mean. Combining marks end words. Columns of `docs` named like a result are replaced;
    repeated rows each get a row.
    """
    rows = docs.drop("lang_pred", "score")
    name = free_name(rows, "__found")
    return rows.withColumn(name, predictor(docs, model)).select(*rows.columns, F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))


def predict(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` per row of `docs` (doc_id, text, lang, any others); an empty table gives none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return languages(rows, train(docs, vocabulary)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of `docs` whose text is in a learned language with a score of `least` or more, with their columns."""
    name = free_name(docs, "__found")
    found = docs.withColumn(name, predictor(docs, train(docs, vocabulary)))
    return found.where((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["score"] >= least)).drop(name)

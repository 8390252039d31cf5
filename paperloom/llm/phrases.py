"""Phrases that occur more often than their parts suggest, mined by pivot partitioning.

Every occurrence of an n-gram has one owner: the position of its rarest word (the leftmost of equal ones). A text
piece is rewritten, for each position as pivot, to the fragment around it whose words are at least as frequent; rarer
words and those below the support end it. Equal fragments are summed where they arise, then routed to their pivot
word, where they are cut into the n-grams that the pivot owns, and only those are counted. A pivot's counts are
complete there, so what is below the support goes no further; the fragments of a very frequent pivot are dealt to
several tasks, and what these count is summed once more.

Rarity comes from a count-min table of the frequent words' counts: of bounded size, the same for all tasks. Any order
of words gives the same counts, so what collides in the table costs balance, not exactness. A phrase of the support has only
word pairs of the support, so a fragment also ends between two words whose pair can't have it: pairs are counted in hashed
cells, of which one bit each says whether it reached the support; pairs that share a cell cost volume, not exactness. Words are
grouped by 64-bit hashes inside a task, and held against their bytes.

Texts are read whole, in blocks cut between pieces. Null texts have no words; a null language is `und`.
Repeated rows count as often as they are there, rows without an id like others; columns beside `text` and `lang` have no influence. An empty table gives no
phrases. Ties are settled by the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, made, written
from .textkernel import Words, byte_class, mix, tidy, utf8, xxh64

_BREAKS = [(ord(c), ord(c)) for c in ".,;:!?"] + [(0x0A, 0x0D)]
#: Bytes that end a piece, and bytes of words.
_ENDS = ~byte_class(_BREAKS)
_INSIDE = byte_class([(0x20, 0x20), (0x09, 0x09), *_BREAKS])
#: Bytes of text that are worked on at once.
BLOCK_BYTES = 4 << 20
#: The count-min table: rows, and bounds of its cells a row, 4 bytes each; in between, cells for each frequent word.
_ROWS, _LEAST_CELLS, _MOST_CELLS, _CELLS_A_WORD = 2, 1 << 14, 1 << 23, 8
#: Bounds of the cells that pairs are counted in, one bit each when shared; in between, one for each word of the texts.
_LEAST_PAIRS, _MOST_PAIRS = 1 << 20, 1 << 29
#: Buckets that words are counted in.
_BUCKETS = 1 << 10
#: Cells that are counted together in a task.
_SPAN = 1 << 20
#: Occurrences of a pivot whose fragments go to one task.
PIVOT_OCCURRENCES = 1 << 14
#: Bits of a route that aren't used: 2**24 routes.
_ROUTE_SHIFT = 40
#: Parts that a language's phrases are ranked in before the last ranking.
_RANK_PARTS = 64


def _blocks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and language numbers of runs of whole pieces with about `limit` bytes: at ends of texts and, in long
    texts, of pieces. A longer piece makes a block of its own."""
    data, offsets = utf8(batch.column("text"))
    cuts = [offsets]
    for i in np.flatnonzero(np.diff(offsets) > limit).tolist():
        ends = offsets[i] + 1 + np.flatnonzero(_ENDS[data[offsets[i] : offsets[i + 1]]])
        at = np.searchsorted(ends, np.arange(offsets[i] + limit, offsets[i + 1], limit))
        cuts.append(ends[np.unique(at[at < len(ends)])])
    bounds = np.unique(np.concatenate(cuts))
    row = np.searchsorted(offsets, bounds[:-1], side="right") - 1
    begin = 0
    while begin < len(row):
        end = int(np.searchsorted(bounds, bounds[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), len(row))
        yield data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin], row[begin:end]
        begin = end


#: Stands after each text of a bundle; no word has it.
_END = 10


def _bundled(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The spans of `data`, each with a line break after it, as a string for each range of spans that `bounds` cut."""
    size = end - start + 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.append(data, np.uint8(_END))[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    out[offsets[1:] - 1] = _END
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets[bounds].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _ranges(*keys: np.ndarray) -> np.ndarray:
    """Where ranges of equal keys begin, and their end."""
    n = len(keys[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _unbundled(*lists: str) -> Column:
    """An array of structs of a bundle's `texts` as `text` and what `lists` have for each."""
    return F.arrays_zip(F.split("texts", "\n").alias("text"), *lists)


class Block:
    """The words of a block: spaced bytes, bounds, languages, `opens` (a piece's first word), and for each distinct word of
    a language `code`, with its first place and its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, salts: np.ndarray):
        words = Words(data, offsets, _INSIDE)
        n = len(words)
        pieces = np.cumsum(_ENDS[data])
        self.opens = np.ones(n + 1, bool)
        self.opens[1:n] = pieces[words.start[1:]] != pieces[words.start[:-1]]
        self.opens[words.first[:-1]] = True
        self.data, self.start, self.end = words.joined() if n else (words.data, words.start, words.end)
        self.lang = np.repeat(langs, words.counts)
        hashes = mix(xxh64(self.data, self.start, self.end) ^ salts[self.lang])
        self.hash, self.at, self.code = np.unique(hashes, return_index=True, return_inverse=True)
        if not self._exact():
            self._group_by_bytes(hashes)

    def _exact(self) -> bool:
        """Whether words with equal hashes are equal."""
        own, seen = np.arange(len(self.code)), self.at[self.code]
        size = self.end - self.start
        if (size != size[seen]).any() or (self.lang != self.lang[seen]).any():
            return False
        other = np.flatnonzero(own != seen)
        for k in range(0, int(size.max(initial=0)), 8):  # eight bytes a step, of the words that are longer
            other = other[size[other] > k]
            for d in range(8):
                live = other[size[other] > k + d]
                if (self.data[self.start[live] + k + d] != self.data[self.start[seen[live]] + k + d]).any():
                    return False
        return True

    def _group_by_bytes(self, hashes: np.ndarray) -> None:
        known: dict[tuple[int, bytes], int] = {}
        raw = self.data.tobytes()
        keys = zip(self.lang.tolist(), self.start.tolist(), self.end.tolist(), strict=True)
        self.code = np.array([known.setdefault((lang, raw[i:j]), len(known)) for lang, i, j in keys], np.int64)
        self.at = np.unique(self.code, return_index=True)[1]
        self.hash = hashes[self.at]


def _salts(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in names], np.uint64)


def _worked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[Block, list[str]]]:
    for batch in batches:
        column = batch.column("lang").dictionary_encode()
        names, of = column.dictionary.to_pylist(), column.indices.to_numpy(zero_copy_only=False)
        salts = _salts(names)
        for data, offsets, row in _blocks(batch, limit):
            yield Block(data, offsets, of[row], salts), names
        tidy()


def count_words(texts: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """`lang, word, n`, summed within blocks, whose words travel in bundles; the empty word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names in _worked(batches, limit):
            here, total = np.unique(block.lang, return_counts=True)
            lang, start, end = block.lang[block.at], block.start[block.at], block.end[block.at]
            bucket, seen = (block.hash % np.uint64(_BUCKETS)).astype(np.int64), np.bincount(block.code, minlength=len(block.at))
            # the number of all words is that of a word without letters, in a bucket of the language
            lang, start, end = np.concatenate([lang, here]), np.append(start, np.zeros_like(here)), np.append(end, np.zeros_like(here))
            bucket, seen = np.append(bucket, here % _BUCKETS), np.append(seen, total)
            by = np.lexsort((start, lang, bucket))
            bounds = _ranges(bucket[by], lang[by])
            first = by[bounds[:-1]]
            columns = [pa.array(bucket[first].astype(np.int32)), pa.array(names, pa.string()).take(pa.array(lang[first])), _bundled(block.data, start[by], end[by], bounds), _lists(seen[by].astype(np.int32), bounds)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "lang", "texts", "n"])

    found = texts.mapInArrow(run, "bucket int, lang string, texts string, n array<int>").repartition("bucket")
    rows = found.select("bucket", "lang", F.explode(_unbundled("n")).alias("w")).where("w.n is not null").select("bucket", "lang", F.col("w.text").alias("word"), "w.n")
    return rows.groupBy("bucket", "lang", "word").agg(F.sum("n").alias("n")).groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Rarity:
    """Counts of words from above, by hash: a count-min table."""

    def __init__(self, cells: int):
        self.table = np.zeros((_ROWS, cells), np.float32)

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.table.shape[1] - 1)
        return [((hashes >> np.uint64(32 * k)) & mask).astype(np.int64) for k in range(_ROWS)]

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.table[k][at] for k, at in enumerate(self.places(hashes))])


def rarity(words: DataFrame, cells: int | None = None) -> Rarity:
    """The table of the frequent words' counts (lang, word, n); its cells, not the words, come to the driver."""
    if cells is None:
        wanted = min(_MOST_CELLS, max(_LEAST_CELLS, _CELLS_A_WORD * words.count()))
        cells = 1 << (wanted - 1).bit_length()
    empty = Rarity(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Rarity(cells).places
        for batch in batches:
            column = batch.column("lang").dictionary_encode()
            data, offsets = utf8(batch.column("word"))
            hashes = mix(xxh64(data, offsets[:-1], offsets[1:]) ^ _salts(column.dictionary.to_pylist())[column.indices.to_numpy()])
            for k, at in enumerate(places(hashes)):
                yield pa.RecordBatch.from_arrays([pa.array(at + k * cells), batch.column("n")], ["cell", "n"])

    counted = words.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").cast("float").alias("n"))
    found = counted.toArrow()
    empty.table.reshape(-1)[found["cell"].to_numpy()] = found["n"].to_numpy()
    return empty


def _pair_cells(block: Block, cells: int) -> np.ndarray:
    """The cell of each word and the next one."""
    hashes = block.hash[block.code]
    with np.errstate(over="ignore"):
        return (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) & np.uint64(cells - 1)).astype(np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their low bytes first, then the next: small numbers leave long runs of zeros."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64)


def pair_filter(texts: DataFrame, known: Rarity, support: int, words: int, limit: int = BLOCK_BYTES) -> np.ndarray:
    """A bit for each cell of pairs of frequent words: whether `support` pairs or more fell into it. Cells are summed by
    ranges of equal size; the bits, an eighth of a byte a cell, come to the driver."""
    cells = 1 << (min(_MOST_PAIRS, max(_LEAST_PAIRS, words)) - 1).bit_length()
    span = min(_SPAN, cells)
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _worked(batches, limit):
            frequent = (shared.value.counts(block.hash) >= support)[block.code]
            together = frequent[:-1] & frequent[1:] & ~block.opens[1 : len(frequent)]
            cell, n = np.unique(_pair_cells(block, cells)[together], return_counts=True)
            bounds = np.searchsorted(cell, np.arange(0, cells + 1, span))
            part = np.flatnonzero(np.diff(bounds))
            at = [_planes(np.diff(cell[bounds[k] : bounds[k + 1]], prepend=k * span)) for k in part]
            counts = [_planes(n[bounds[k] : bounds[k + 1]]) for k in part]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["part", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(held >= support).tobytes()], pa.binary())], ["part", "bits"])
        for batch in batches:
            for part, at, n in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "n")), strict=True):
                if part != now:
                    if now is not None:
                        yield out()
                    now, held = part, np.zeros(span, np.int64)
                held[np.cumsum(_numbers(at))] += _numbers(n)
        if now is not None:
            yield out()

    counted = texts.mapInArrow(run, "part long, at binary, n binary").repartition("part").sortWithinPartitions("part")
    found = counted.mapInArrow(add, "part long, bits binary").toArrow()
    bits = np.zeros(cells // 8, np.uint8)
    for part, some in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        bits[part * span // 8 :][: len(some)] = np.frombuffer(some, np.uint8)
    return bits


def _cut(block: Block, bits: np.ndarray) -> None:
    """Ends pieces between words whose pair's bit isn't set."""
    cell = _pair_cells(block, 8 * len(bits))
    block.opens[1 : len(block.code)] |= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 0


def _owned(block: Block, counts: np.ndarray, support: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that own n-grams, and how many words left and right of each its fragment takes."""
    # ranks in the one order of all tasks: by count, then by hash
    order = np.lexsort((block.hash, counts))
    new = np.ones(len(order), bool)
    new[1:] = (counts[order][1:] != counts[order][:-1]) | (block.hash[order][1:] != block.hash[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    rank[counts < support] = 0
    n, reach = len(block.code), longest - 1
    padded = np.zeros(n + 2 * reach, np.int64)
    padded[reach : reach + n] = rank[block.code]
    opens = np.ones(n + 2 * reach, bool)
    opens[reach : reach + n] = block.opens[:n]
    at = np.flatnonzero(padded)
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for d in range(1, reach + 1):
        own = padded[at]
        left += (left == d - 1) & ~opens[at - d + 1] & (padded[at - d] > own)
        right += (right == d - 1) & ~opens[at + d] & (padded[at + d] >= own)
    some = left + right > 0
    return at[some] - reach, left[some], right[some]


def _alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of equal rows, and how many there are."""
    key = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            key = mix(key * np.uint64(3) + rows[:, k].astype(np.uint64) + np.uint64(1))
    by = np.argsort(key)
    key, sorted_rows = key[by], rows[by]
    new = np.ones(len(by), bool)
    new[1:] = (sorted_rows[1:] != sorted_rows[:-1]).any(1)
    if (new[1:] & (key[1:] == key[:-1])).any():  # two kinds with one key
        _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
        return first, n
    start = np.flatnonzero(new)
    return by[start], np.diff(np.append(start, len(by)))


def fragments(texts: DataFrame, known: Rarity, pairs: np.ndarray, support: int, longest: int, limit: int = BLOCK_BYTES, share: int = PIVOT_OCCURRENCES) -> DataFrame:
    """`lang, route, split, texts, at, n`: bundles of a pivot's fragments, with the place of the pivot in each, summed within
    blocks. `route` is the pivot's hash, and for a pivot of more than `share` occurrences (`split`) one of several of it, by the fragment."""
    # _MOST_CELLS and _MOST_PAIRS at most: 64 MB each
    shared = texts.sparkSession.sparkContext.broadcast((known, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = longest - 1
        for block, names in _worked(batches, limit):
            rare, bits = shared.value
            counts = rare.counts(block.hash)
            _cut(block, bits)
            at, left, right = _owned(block, counts, support, longest)
            padded = np.zeros(len(block.code) + 2 * reach, np.int32)
            padded[reach : reach + len(block.code)] = block.code + 1
            steps = np.arange(-reach, reach + 1)
            inside = (steps >= -left[:, None]) & (steps <= right[:, None])
            first, n = _alike(np.where(inside, padded[at[:, None] + reach + steps], 0))
            at, left, right = at[first], left[first], right[first]
            start, end = block.start[at - left], block.end[at + right]
            code = block.code[at]
            parts = np.maximum(np.ceil(counts[code].astype(float) / share).astype(np.uint64), np.uint64(1))
            part = xxh64(block.data, start, end) % parts
            by = np.lexsort((start, part, code))
            bounds = _ranges(code[by], part[by])
            head = by[bounds[:-1]]
            with np.errstate(over="ignore"):
                route = mix(block.hash[code[head]] + part[head] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(_ROUTE_SHIFT)
            columns = [
                pa.array(names, pa.string()).take(pa.array(block.lang[at[head]])), pa.array(route.astype(np.int32)), pa.array(parts[head] > 1),
                _bundled(block.data, start[by], end[by], bounds), _lists(left[by].astype(np.int8), bounds), _lists(n[by].astype(np.int32), bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "route", "split", "texts", "at", "n"])

    return texts.mapInArrow(run, "lang string, route int, split boolean, texts string, at array<tinyint>, n array<int>")


def _mined(bundles: DataFrame, support: int, longest: int) -> DataFrame:
    """`lang, phrase, words, f` of the n-grams that fragments own, those of the support or more."""
    grams = F.expr(f"""flatten(transform(sequence(0, int(at)), i -> transform(
        filter(sequence(int(at), size(words) - 1), j -> j > i and j - i < {longest}), j -> array_join(slice(words, i + 1, j - i + 1), ' '))))""")
    routed = bundles.repartition("route").select("route", "lang", "split", F.explode(_unbundled("at", "n")).alias("f")).where("f.n is not null")
    routed = routed.select("route", "lang", "split", F.split("f.text", " ").alias("words"), "f.at", "f.n")
    mined = routed.select("lang", "route", "split", F.explode(grams).alias("phrase"), "n").groupBy("route", "lang", "split", "phrase").agg(F.sum("n").alias("n"))
    whole = mined.where(F.col("split") | (F.col("n") >= support)).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support)
    return whole.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", first, length), " ")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(docs: DataFrame, support: int = 30, longest: int = 4, inside: tuple[int, int] = (80, 100), most: int | None = 2000) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: per language the phrases of 2 to `longest` words with `support` occurrences
    or more, without those that lie in a longer one with at least `inside` of their occurrences; the `most` first.

    `a`, `l` and `r` count the phrase and the two parts of its weakest cut, `n` all words; `score` is 2,000,000 a / (l + r), floored.
    """
    begun = made()
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    words = written(count_words(texts).where((F.col("n") >= support) | (F.col("word") == "")), "phrases-words")
    frequent = words.where("word <> ''")
    known = rarity(frequent)
    pairs = pair_filter(texts, known, support, words.where("word = ''").agg(F.sum("n")).first()[0] or 0)
    mined = _mined(fragments(texts, known, pairs, support, longest), support, longest)
    counts = written(mined.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))), "phrases-counts")
    several = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    # the weakest cut: both parts of a frequent phrase are frequent, so they have counts
    cuts = several.select("lang", "phrase", F.col("f").alias("a"), "words", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    parts = counts.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    # how often the most frequent longer phrase around each has it
    spans = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    around = several.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    low, whole = (F.lit(x).cast("decimal(18,0)") for x in inside)
    kept = weakest.select("lang", "phrase", "cut.*").join(around, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (whole * _exact("longer") < low * _exact("a")))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if most is not None:  # so many from each of some parts of a language, so that no task ranks all of it
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_RANK_PARTS))).orderBy(*best))).where(F.col("place") <= most)
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    else:
        kept = kept.withColumn("rank", F.lit(None).cast("long"))
    totals = words.where("word = ''").select("lang", "n")
    ranked = written(kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases-ranked")
    discard(docs.sparkSession, begun)
    return ranked


ORACLE_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), worded as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces
), grams as (
  select lang, k, unnest(list_transform(range(1, greatest(len(w) - k, 0) + 2), lambda i: case when i + k - 1 <= len(w) then array_to_string(w[i : i + k - 1], ' ') end)) as phrase
  from worded, (select unnest([1, 2, 3, 4]) as k)
), counts as materialized (
  select lang, k as words, phrase, count(*) as f from grams where phrase is not null group by all
), totals as (
  select lang, sum(f)::bigint as n from counts where words = 1 group by lang
), candidates as (
  select lang, words, phrase, f as a, string_split(phrase, ' ') as w from counts where words > 1 and f >= 30
), halves as (
  select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail from (select *, unnest(range(1, words)) as k from candidates)
), cuts as (
  select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, (2000000::hugeint * c.a) // (l.f::hugeint + r.f) as score
  from halves c join counts l on l.lang = c.lang and l.phrase = c.head join counts r on r.lang = c.lang and r.phrase = c.tail
), weakest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), around as (
  select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, max(a) as longer
  from candidates, (select unnest([2, 3]) as k), (select unnest([1, 2, 3]) as i) where k < words and i + k - 1 <= words group by all
)
select w.lang, row_number() over (partition by w.lang order by w.score desc, w.a desc, w.phrase) as rank, w.phrase, w.a, w.l, w.r, t.n, w.score::bigint as score
from weakest w join totals t on t.lang = w.lang left join around o on o.lang = w.lang and o.phrase = w.phrase
where o.longer is null or 100::hugeint * o.longer < 80::hugeint * w.a
qualify rank <= 2000
"""

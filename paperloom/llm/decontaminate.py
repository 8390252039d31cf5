"""Benchmark decontamination by suffix arrays over the documents.

The documents are cut into shards, each a few megabytes of whole texts. A shard's words become the
ranks of the benchmark's words, and a suffix array holds those positions at which a match with a
benchmark window can begin. Every test suffix is found in it by binary search: the positions
between its bounds are the occurrences, and the neighbours give its longest verbatim match.
Positions left out of the array can't begin a match: the run of benchmark words there is shorter
than each window that starts with that word. Suffixes whose first two words occur at none of the positions left aren't
searched. Where a document is hit, its longest verbatim match is found the other way, by searching the hit's suffix
in the suffix array of the benchmark.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .textkernel import ALNUM, Words, slices, utf8, xxh64

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Benchmark bytes that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 16 << 20


@dataclass
class Suffixes:
    """A block of the benchmark: its word ids in one sequence, and its windows and suffixes."""

    vocabulary: np.ndarray  # sorted word hashes; a word's id is its place here plus 1
    words: np.ndarray  # ids, items one after another, 0 after each
    item: np.ndarray  # item number of each place
    items: list[int | None]  # item ids
    window_at: np.ndarray  # first place of each distinct window
    window_size: np.ndarray
    window_items: list[list[int]]  # the items that have it
    order: np.ndarray  # suffix array of the items
    longest: int = field(init=False)  # words of the longest item
    needs: np.ndarray = field(init=False)  # by word id, the shortest window that starts with it

    def __post_init__(self) -> None:
        self.longest = int(_runs(self.words).max(initial=0))
        self.needs = np.full(len(self.vocabulary) + 1, np.iinfo(np.int64).max)
        if len(self.window_at):
            np.minimum.at(self.needs, self.words[self.window_at], self.window_size)

    @classmethod
    def build(cls, ids: list[int], texts: list[str | None], window: int = WINDOW) -> Suffixes:
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        w = Words(data, offsets, ALNUM)
        hashes = xxh64(w.data, w.start, w.end)
        vocabulary, rank = np.unique(hashes, return_inverse=True)
        count = w.counts
        words = np.zeros(len(w) + len(texts), np.int64)
        row = np.repeat(np.arange(len(texts)), count)
        words[np.arange(len(w)) + row] = rank + 1
        item = np.repeat(np.arange(len(texts)), count + 1)
        start = w.first[:-1] + np.arange(len(texts))
        seen: dict[bytes, int] = {}
        at, size, of = [], [], []
        for k in np.flatnonzero(count):
            n = min(window, int(count[k]))
            for p in range(start[k], start[k] + count[k] - n + 1):
                key = words[p : p + n].tobytes()
                if key not in seen:
                    seen[key] = len(at)
                    at.append(p)
                    size.append(n)
                    of.append([])
                held = of[seen[key]]
                if ids[k] is not None and (not held or held[-1] != ids[k]):
                    held.append(ids[k])
        order = suffix_array(words, np.flatnonzero(words), int(_runs(words).max(initial=0)))
        return cls(vocabulary, words, item, ids, np.array(at, np.int64), np.array(size, np.int64), of, order)


def _runs(words: np.ndarray) -> np.ndarray:
    """At each place, how many benchmark words follow, itself included, before the next 0."""
    if not len(words):
        return np.zeros(0, np.int64)
    zero = np.flatnonzero(words == 0)
    nxt = zero[np.searchsorted(zero, np.arange(len(words)))]
    return nxt - np.arange(len(words))


def suffix_array(words: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """`places` in the order of the first `most` words of the suffixes that begin there; a suffix ends at
    its 0, which is least. Equal ones stay in order of place. No search compares more than the longest
    item's words, so `most` is that many, however long a text repeats itself."""
    order, group, depth = places, np.zeros(len(places), np.int64), 0
    tied = np.arange(len(places))
    while len(tied) and depth < most:
        at = order[tied]
        key = words[np.minimum(at + depth, len(words) - 1)]
        by = np.lexsort((at, key, group[tied]))
        order[tied] = at[by]
        key = key[by]
        g = group[tied]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        head = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        group[tied] = head
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        open_ = np.repeat(size > 1, size) & (key > 0)
        tied, depth = tied[open_], depth + 1
    return order


def _match(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that agree from a[p] and b[q] on, up to `most` and short of any 0."""
    n = np.zeros(len(p), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = a[np.minimum(p[live] + n[live], len(a) - 1)]
        y = b[np.minimum(q[live] + n[live], len(b) - 1)]
        live = live[(x == y) & (x > 0)]
        n[live] += 1
        live = live[n[live] < most[live]]
    return n


def search(words: np.ndarray, order: np.ndarray, test: np.ndarray, at: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """By binary search, the first place in `order` whose suffix isn't below test[at:at+size], or, with
    `after`, the first whose suffix is above all that begin with it."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order))
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live]) // 2
        n = _match(words, order[mid], test, at[live], size[live])
        full = n == size[live]
        x = words[np.minimum(order[mid] + n, len(words) - 1)]
        y = test[np.minimum(at[live] + n, len(test) - 1)]
        right = np.where(full, after, x < y)
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]


class Shard:
    """Word ids of a run of texts, and the suffix array of the places where a window can begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: Suffixes):
        w = Words(data, offsets, ALNUM)
        self.count, self.first = w.counts, w.first
        hashes = xxh64(w.data, w.start, w.end)
        texts = len(self.count)
        self.words = np.zeros(len(w) + texts, np.int64)
        if len(block.vocabulary):
            place = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
            ids = np.where(block.vocabulary[place] == hashes, place + 1, 0)
        else:
            ids = np.zeros(len(w), np.int64)
        self.row = np.repeat(np.arange(texts), self.count + 1)
        self.words[np.arange(len(w)) + np.repeat(np.arange(texts), self.count)] = ids
        runs = _runs(self.words)
        self.order = suffix_array(self.words, np.flatnonzero(runs >= block.needs[self.words]), block.longest)

    def start(self, row: np.ndarray) -> np.ndarray:
        return self.first[row] + row

    def occurrences(self, block: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of each occurrence of each window."""
        if not len(self.order) or not len(block.window_at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pick = np.flatnonzero(self.begins(block))
        at, size = block.window_at[pick], block.window_size[pick]
        low = search(self.words, self.order, block.words, at, size, False)
        high = search(self.words, self.order, block.words, at, size, True)
        n = high - low
        window = np.repeat(pick, n)
        k = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return window, self.order[k]

    def begins(self, block: Suffixes) -> np.ndarray:
        """Which windows' first words, two if they have as many, occur where one can begin."""
        wide = np.int64(len(block.vocabulary) + 1)
        nxt = lambda words, at: words[np.minimum(at + 1, len(words) - 1)]
        one, two = block.words[block.window_at], nxt(block.words, block.window_at)
        here = self.words[self.order]
        single = np.zeros(int(wide), bool)
        single[here] = True
        return np.where(block.window_size > 1, np.isin(one * wide + two, here * wide + nxt(self.words, self.order)), single[one])

    def longest_from(self, place: np.ndarray, block: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """For the suffix at each place, the words of its longest verbatim match and where in the block that begins."""
        size = _runs(self.words)[place]
        point = search(block.words, block.order, self.words, place, size, False)
        best, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for k in (point - 1, point):
            ok = np.flatnonzero((k >= 0) & (k < len(block.order)))
            n = _match(block.words, block.order[k[ok]], self.words, place[ok], size[ok])
            better = n > best[ok]
            best[ok[better]], where[ok[better]] = n[better], block.order[k[ok[better]]]
        return best, where

    def longest(self, block: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every test suffix: its place, the longest match's words, and where that begins (-1: none)."""
        at = np.flatnonzero(block.words)
        size = _runs(block.words)[at]
        best, where = np.zeros(len(at), np.int64), np.full(len(at), -1)
        if len(self.order):
            point = search(self.words, self.order, block.words, at, size, False)
            for k in (point - 1, point):
                ok = np.flatnonzero((k >= 0) & (k < len(self.order)))
                n = _match(self.words, self.order[k[ok]], block.words, at[ok], size[ok])
                better = n > best[ok]
                best[ok[better]], where[ok[better]] = n[better], self.order[k[ok[better]]]
        return at, best, where


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """The benchmark in blocks of at most about `limit` bytes, one at a time on the driver."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield [r.item_id for r in got], [r.text for r in got]


_FOUND = "n_words long, hits array<struct<begin: long, end: long>>, items array<long>, longest struct<n_words: long, doc_word: long, item_id: long, item_word: long>"


def _marker(docs: DataFrame, block: Suffixes) -> Column:
    """What the benchmark block finds in `text`; only the text passes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    place_of = np.searchsorted(block.item, np.arange(len(block.items)))

    def run(texts: pa.Array) -> pa.Array:
        block = shared.value
        count, hits, items, longest = [], [], [], []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            shard = Shard(*utf8(part.column("text")), block)
            window, place = shard.occurrences(block)
            row = shard.row[place]
            begin = place - shard.start(row)
            end = begin + block.window_size[window]
            size, where = shard.longest_from(place, block)
            found: list[tuple] = [([], [], None)] * part.num_rows
            by = np.lexsort((end, begin, row))
            cut = np.searchsorted(row[by], np.append(np.unique(row), part.num_rows))
            for a, b in itertools.pairwise(cut.tolist()):
                own = by[a:b]
                of = {i for k in np.unique(window[own]) for i in block.window_items[k]}
                most = own[np.argmax(size[own])]  # the first of the longest
                item = block.item[where[most]]
                match = {"n_words": int(size[most]), "doc_word": int(begin[most]), "item_id": block.items[item], "item_word": int(where[most] - place_of[item])}
                found[row[own[0]]] = merged(begin[own], end[own]), sorted(of), match
            count.append(shard.count)
            hits += [f[0] for f in found]
            items += [f[1] for f in found]
            longest += [f[2] for f in found]
        kind = pa.struct([(n, pa.int64()) for n in ("n_words", "doc_word", "item_id", "item_word")])
        runs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.int64), *count]), pa.int64()), pa.array(hits, runs), pa.array(items, pa.list_(pa.int64())), pa.array(longest, kind)],
            ["n_words", "hits", "items", "longest"],
        )

    return F.arrow_udf(run, _FOUND)(F.col("text"))


def merged(begin: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
    """Sorted runs, merged where they meet."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return [{"begin": a, "end": b} for a, b in zip(begin[new].tolist(), reach[last].tolist(), strict=True)]


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, name: str) -> DataFrame:
    """`docs` with what each block finds in the column `name`, an array."""
    marks = [_marker(docs, Suffixes.build(ids, texts, window)) for ids, texts in _blocks(benchmark, block_bytes)]
    # the text passes to Python once for all blocks; a generator in between keeps what they found from being found again
    return docs.withColumn(name, F.explode(F.array(F.array(*marks))))


def _hit_words(found: str) -> Column:
    """Words that the hit runs of all blocks cover together; a block's own runs are apart."""
    runs = F.array_sort(F.flatten(F.col(found)["hits"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    more = lambda a, x: F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["begin"], a["reach"]))
    step = lambda a, x: F.struct((a["n"] + more(a, x)).alias("n"), F.greatest(a["reach"], x["end"]).alias("reach"))
    return F.aggregate(runs, start, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` with `n_words, n_hit, n_items, items_sha256, contaminated, longest_match` after their columns.

    A document word is hit inside any occurrence of a window of `window` consecutive item words, or of
    the whole item if it has fewer. `contaminated`: hits make up a twentieth of the words or more. `longest_match` is
    the longest verbatim match that begins at an occurrence: `n_words, doc_word, item_id, item_word`, places counted from 0,
    null without one; of equally long ones the first in the document. Null texts have no words, an empty or null item no
    window; items that share a text all count, those without an id hit words but aren't among the items; repeated
    documents each get their row. Columns of `docs` named like a result are replaced.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"]
    name, hit = free_name(docs, "__found"), free_name(docs, "__hit")
    found = _found(docs, benchmark, window, block_bytes, name).withColumn(hit, _hit_words(name))
    items = F.array_distinct(F.flatten(F.col(name)["items"]))
    longest = F.array_max(F.transform(F.col(name)["longest"], lambda x: F.struct(x["n_words"].alias("n"), (-x["doc_word"]).alias("at"), x.alias("x"))))["x"]
    values = {
        "n_words": F.col(name)[0]["n_words"],
        "n_hit": F.col(hit),
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",").cast("binary"), 256),
        "contaminated": (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(name)[0]["n_words"]),
        "longest_match": longest,
    }
    return found.select(*(c for c in docs.columns if c not in added), *(v.alias(n) for n, v in values.items()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with their columns, whatever their names."""
    name, hit = free_name(docs, "__found"), free_name(docs, "__hit")
    found = _found(docs, benchmark, window, BLOCK_BYTES, name).withColumn(hit, _hit_words(name))
    return found.where((F.col(hit) == 0) | (20 * F.col(hit) < F.col(name)[0]["n_words"])).drop(name, hit)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`item_id, item_word, doc_id, doc_word, n_words`: for every test suffix and shard, the longest verbatim
    match of a window's length or more, and where it begins; counted from 0."""
    found = None
    for ids, texts in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Suffixes.build(ids, texts, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            begins = np.searchsorted(block.item, np.arange(len(block.items)))
            for batch in batches:
                for part in slices(batch, "text"):
                    shard = Shard(*utf8(part.column("text")), block)
                    at, n, place = shard.longest(block)
                    item = block.item[at]
                    whole = np.append(begins[1:], len(block.words))[item] - 1 - begins[item]
                    ok = n >= np.minimum(window, whole)
                    at, n, place, item = at[ok], n[ok], place[ok], item[ok]
                    row = shard.row[place]
                    out = [
                        pa.array([block.items[i] for i in item], pa.int64()),
                        pa.array(at - begins[item]),
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(place - shard.start(row)),
                        pa.array(n),
                    ]
                    yield pa.RecordBatch.from_arrays(out, ["item_id", "item_word", "doc_id", "doc_word", "n_words"])

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item_id long, item_word long, doc_id long, doc_word long, n_words long")
        found = one if found is None else found.union(one)
    return found

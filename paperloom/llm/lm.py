"""Language-model scoring with a log-frequency Bloom filter.

Tokens are words and one end per text. Counts of tokens are kept exactly, those of token pairs are
quantised: a pair that was seen c times goes into the filter once for each of the levels 1 to
1 + floor(log2 c), and repeated membership probes, level by level, give its count back to
within a factor of 2, from below. A shard knows the pairs that it has seen, so those few that a false level would raise
are listed beside the filter; pairs that were never seen can be false positives. A token's probability is the
pair's share smoothed towards the token's own:

    p(w | u) = (t(u) c(u, w) + m(u) p(w)) / (c(u) + m(u)),   p(w) = (c(w) + 1) / (N + V + 1)

where m(u) = MASS * c(u)^POWER follows how many different tokens a context has been seen with, and
t(u) = c(u) / (c(u) + F(u)) takes off what false positives add: F(u) is the false count that V tokens could show after the
context, with four standard deviations to spare. So a context's probabilities sum to 1 at most. F(u) is a small share of c(u) at every size, because pairs of a rare context have more
hash functions: as many as it takes for V tokens to add SPARE of its count. How frequent a context is, to a factor of 2, is read
from a table of hashed cells, of bounded size; contexts that share a cell are taken for the rarest. Exact counts have no F.

Counting is distributed by hash, first of tokens, then of pairs; each shard builds its part of the counts and of the filter,
and these are broadcast, some shards at a time, if together they are at most `BROADCAST_BYTES`. They grow with the corpus, so a
larger model is not broadcast: each run of texts then asks the shards about its different tokens and pairs, and
is scored with their answers. Scores don't depend on which way is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textkernel import Words, mix, slices, tidy, utf8, xxh64

#: Weight of the smoothing distribution, in occurrences of the context.
MASS, POWER = 4.0, 0.8
#: Bounds of the hash functions of an entry of the first level, and how many one of a higher level has; filters are half full.
LEAST, MOST, HIGHER = 2, 48, 6
#: Share of a context's count that false followers may add.
SPARE = 0.2
#: Bounds of the cells that contexts' frequencies are read from, a byte each; in between, so many for a token. Cells of a range.
_LEAST_CELLS, _MOST_CELLS, _CELLS_A_TOKEN, _SPAN = 1 << 16, 1 << 26, 4, 1 << 20
#: Model bytes up to which it is broadcast, and of the shards that are broadcast together: the driver holds no more of it at once.
BROADCAST_BYTES, PIECE_BYTES = 256 << 20, 16 << 20
#: Tokens that are counted in a task before what is counted is passed on, and text bytes for each shard.
FLUSH = 1_500_000
SHARD_BYTES = 8 << 20
_U = np.uint64
# no word holds white space, so no word is one of these
END = xxh64(np.frombuffer(b" ", np.uint8), np.array([0]), np.array([1]))[0]
START = xxh64(np.frombuffer(b"\n", np.uint8), np.array([0]), np.array([1]))[0]


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's token hashes, ends included; the context of each; and where each text begins."""
    w = Words(data, offsets)
    texts = len(offsets) - 1
    begin = w.first + np.arange(texts + 1)
    out = np.full(len(w) + texts, END, np.uint64)
    row = np.repeat(np.arange(texts), w.counts)
    out[np.arange(len(w)) + row] = xxh64(w.data, w.start, w.end)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[begin[:-1]] = START
    return out, before, begin


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before + _U(0x9E3779B97F4A7C15)) + token)


def levels(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 0 for 0."""
    return np.frexp(np.asarray(count, np.float64))[1]


#: What an unseen pair that shows a count shows on average, with further false levels above the first.
FALSE_COUNT = 1 + 2.0**-HIGHER / (1 - 2.0 ** (1 - HIGHER))


def functions(frequency: np.ndarray, distinct: int) -> np.ndarray:
    """Hash functions of a first-level entry whose context was seen 2**frequency times or more: with them the false count
    of `distinct` tokens, spread included, is SPARE of that."""
    count = 2.0 ** np.where(frequency == _NEVER, 0, frequency).astype(float)
    expected = (np.sqrt(4 + SPARE * count / FALSE_COUNT) - 2) ** 2  # x + 4 sqrt(x), times what each shows, is SPARE * count
    return np.clip(np.ceil(np.log2(max(distinct, 1) / expected)), LEAST, MOST).astype(np.int64)


def false_mass(distinct: int, functions: np.ndarray) -> np.ndarray:
    """The false count after a context, of `distinct` tokens that don't follow it; 4 standard deviations above what is expected."""
    expected = distinct * 2.0 ** -np.asarray(functions, float)
    return FALSE_COUNT * (expected + 4 * expected**0.5)


#: The cell of no context.
_NEVER = 255


@dataclass
class Contexts:
    """The frequency of each context's cell: floor(log2 c) of the rarest token in it. A text's start is as frequent as its end."""

    cells: bytes
    distinct: int

    def __post_init__(self) -> None:
        self.table = np.frombuffer(self.cells, np.uint8)

    def __reduce__(self):  # noqa: ANN204
        return Contexts, (self.cells, self.distinct)

    @staticmethod
    def place(token: np.ndarray, cells: int) -> np.ndarray:
        return (mix(token) & _U(cells - 1)).astype(np.int64)

    def functions(self, context: np.ndarray) -> np.ndarray:
        known = np.where(context == START, END, context)
        return functions(np.arange(256), self.distinct)[self.table[self.place(known, len(self.table))]]


def _hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each key at a level, and the step to each further one."""
    with np.errstate(over="ignore"):
        h = mix(keys + _U(level) * _U(0xD1342543DE82EF95))
        return h, mix(h) | _U(1)


def _slot(place: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A place among so many bits, fewer than 2**32: its upper half's share of them."""
    return ((place >> _U(32)) * bits) >> _U(32)


def build_filter(keys: np.ndarray, counts: np.ndarray, functions: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The packed filter of one shard's pairs, half of its bits set; `functions` are those of the first level. Also the
    pairs, sorted, that a false level would raise, and their levels."""
    level = levels(counts)
    size = max(64, int((int(functions.sum()) + int((level - 1).sum()) * HIGHER) / np.log(2)) + 7 & ~7)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = level >= q
        place, step = _hashes(keys[own], q)
        last = functions[own] if q == 1 else np.full(len(place), HIGHER)
        for k in range(int(last.max(initial=0))):
            bits[_slot(place[last > k], _U(size))] = True
            with np.errstate(over="ignore"):
                place = place + step
    packed = np.packbits(bits, bitorder="little").tobytes()
    shown = Model(0, 0, b"", b"", packed, [0]).pair_level(keys, functions)
    raised = np.flatnonzero(shown > level)
    raised = raised[np.argsort(keys[raised])]
    return packed, keys[raised].tobytes(), level[raised].astype(np.uint8).tobytes()


@dataclass
class Model:
    """Token counts sorted by hash, and the shards' filters one after another. Bytes, so that workers hold one copy."""

    total: int
    distinct: int
    token_keys: bytes
    token_counts: bytes
    filters: bytes | bytearray
    starts: list[int]  # of each shard's filter; a shard is hash mod the number of shards
    contexts: Contexts | None = None
    raised_keys: bytes = b""  # pairs, sorted, and their levels
    raised_levels: bytes = b""

    def __post_init__(self) -> None:
        self.raised = np.frombuffer(self.raised_keys, np.uint64), np.frombuffer(self.raised_levels, np.uint8)
        self.keys = np.frombuffer(self.token_keys, np.uint64)
        self.counts = np.frombuffer(self.token_counts, np.int64 if len(self.token_counts) == len(self.token_keys) else np.uint32)
        self.bytes = np.frombuffer(self.filters, np.uint8)
        self.at = np.array(self.starts, np.uint64)
        self.size = np.diff(np.array([*self.starts, len(self.filters)], np.int64)).astype(np.uint64) * _U(8)

    def __reduce__(self):  # noqa: ANN204
        return Model, (self.total, self.distinct, self.token_keys, self.token_counts, self.filters, self.starts, self.contexts, self.raised_keys, self.raised_levels)

    def shard(self, key: np.ndarray) -> np.ndarray:
        return (key % _U(len(self.at))).astype(np.int64)

    def token_count(self, token: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(token), np.int64)
        at = np.minimum(np.searchsorted(self.keys, token), len(self.keys) - 1)
        return np.where(self.keys[at] == token, self.counts[at], 0).astype(np.int64)

    def pair_level(self, pair: np.ndarray, functions: np.ndarray) -> np.ndarray:
        """By probing level after level until one misses; `functions` are those of each pair's context."""
        out = np.zeros(len(pair), np.int64)
        if not len(self.bytes):
            return out
        shard = self.shard(pair)
        live, q = np.arange(len(pair)), 0
        while len(live):
            q += 1
            live = live[self._holds(pair[live], q, shard[live], functions[live] if q == 1 else np.full(len(live), HIGHER))]
            out[live] = q
        key, level = self.raised
        if len(key):
            at = np.minimum(np.searchsorted(key, pair), len(key) - 1)
            out = np.where(key[at] == pair, level[at], out)
        return out

    def _holds(self, keys: np.ndarray, level: int, shard: np.ndarray, functions: np.ndarray) -> np.ndarray:
        """Places of the keys that are in the filter at a level. Keys that missed are sorted out when they are a quarter."""
        out = np.zeros(len(keys), bool)
        place, step = _hashes(keys, level)
        left, size, begin, last = np.arange(len(keys)), self.size[shard], self.at[shard], functions
        alive = np.ones(len(keys), bool)
        for k in range(int(functions.max())):
            slot = _slot(place, size)
            alive &= ((self.bytes[(begin + (slot >> _U(3))).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1).astype(bool)
            with np.errstate(over="ignore"):
                place = place + step
            done = alive & (last == k + 1)
            out[left[done]] = True
            go = alive & (last > k + 1)
            if np.count_nonzero(go) < 0.75 * len(left):
                left, size, begin, last, place, step = (x[go] for x in (left, size, begin, last, place, step))
                alive = np.ones(len(left), bool)
                if not len(left):
                    break
            else:
                alive = go
        return np.flatnonzero(out)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        token, before, begin = tokens(data, offsets)
        known, inverse = np.unique(token, return_inverse=True)
        count = self.token_count(known)[inverse]
        context = np.empty_like(count)
        context[1:] = count[:-1]
        context[begin[:-1]] = self.token_count(np.array([END]))[0]  # texts begin as often as they end
        pair, first, inverse = np.unique(pairs(before, token), return_index=True, return_inverse=True)
        tests = self.contexts.functions(before[first])
        level, false = self.pair_level(pair, tests)[inverse], false_mass(self.distinct, tests)[inverse]
        seen = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        base = (count + 1) / (self.total + self.distinct + 1)
        mass = MASS * np.maximum(context, 1) ** POWER
        trust = context / np.maximum(context + false, 1e-300)
        p = (trust * np.minimum(seen, context) + mass * base) / (context + mass)  # a pair is no more frequent than its context
        add = lambda x: np.add.reduceat(x, begin[:-1]) if len(begin) > 1 else np.zeros(0)
        return {"n_tokens": np.diff(begin), "n_known": add((count > 0).astype(np.int64)), "base_score": add(np.log10(base)), "score": add(np.log10(p))}


# --- counting


def _counted(docs: DataFrame, shards: int, contexts: Contexts | None = None) -> DataFrame:
    """What each run of training texts holds, by shard, as binaries: `shard, keys, counts` of its tokens, or, with
    `contexts`, of its pairs, and their `functions`."""
    shared = docs.sparkSession.sparkContext.broadcast(contexts)  # _MOST_CELLS bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        tests: list[np.ndarray] = []
        known = shared.value

        def flush() -> pa.RecordBatch:
            key, first, count = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            columns = [key, count.astype(np.uint32)]
            if known:
                columns.append(np.concatenate(tests)[first])
            held.clear()
            tests.clear()
            shard = (key % _U(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            shard = shard[by]
            # only shards that got something: there are no more rows than different keys, however many shards
            own = np.unique(shard)
            cut = np.stack([np.searchsorted(shard, own), np.searchsorted(shard, own, side="right")], 1).tolist()
            out = [pa.array(own.astype(np.int32))]
            for values in columns:
                values = values[by]
                out.append(pa.array([values[a:b].tobytes() for a, b in cut], pa.binary()))
            return pa.RecordBatch.from_arrays(out, ["shard", "keys", "counts", "functions"][: len(out)])

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                token, before, _ = tokens(*utf8(part.column("text")))
                held.append(pairs(before, token) if known else token)
                if known:
                    tests.append(known.functions(before).astype(np.uint8))
                size += len(token)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "shard int, keys binary, counts binary" + (", functions binary" if contexts else ""))


def _merged(parts: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the sums of their counts, and the first of what else stands beside each."""
    key = np.frombuffer(b"".join(p[0] for p in parts), np.uint64)
    count = np.frombuffer(b"".join(p[1] for p in parts), np.uint32)
    rest = np.frombuffer(b"".join(p[2] for p in parts), np.uint8) if parts and len(parts[0]) > 2 else np.zeros(len(key), np.uint8)
    if not len(key):
        return key, count.astype(np.int64), rest
    by = np.argsort(key)
    key = key[by]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(count[by], new, dtype=np.int64), rest[by][new]


def _by_shard(rows: DataFrame, shards: int, make, schema: str) -> DataFrame:  # noqa: ANN001
    """A row per shard that has any: `shard` and the columns that `make` gives of its merged keys."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(row[0], []).append(row[1:])
        for shard in sorted(held):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *make(*_merged(held.pop(shard)))], names)

    return rows.repartitionById(shards, F.col("shard")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, shards: int) -> DataFrame:
    """`shard, total, tokens, token_counts`."""
    binary = lambda x: pa.array([x.tobytes()], pa.binary())
    make = lambda key, count, _: [pa.array([int(count.sum())], pa.int64()), binary(key), binary(count.astype(np.int64))]
    return _by_shard(_counted(docs, shards), shards, make, "shard int, total long, tokens binary, token_counts binary")


def pair_filters(docs: DataFrame, shards: int, contexts: Contexts) -> DataFrame:
    """`shard, filter, raised, raised_levels`."""
    make = lambda key, count, tests: [pa.array([x], pa.binary()) for x in build_filter(key, count, tests.astype(np.int64))]
    return _by_shard(_counted(docs, shards, contexts), shards, make, "shard int, filter binary, raised binary, raised_levels binary")


def contexts_of(counted: DataFrame) -> Contexts:
    """The table of contexts' frequencies from `token_counts`. Ranges of cells are filled in tasks; the cells, a byte each and
    _MOST_CELLS at most, come to the driver."""
    distinct = counted.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    distinct //= 8
    cells = 1 << (min(_MOST_CELLS, max(_LEAST_CELLS, _CELLS_A_TOKEN * distinct)) - 1).bit_length()
    span = min(_SPAN, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("tokens").to_pylist(), batch.column("token_counts").to_pylist(), strict=True):
                place = Contexts.place(np.frombuffer(keys, np.uint64), cells)
                by = np.argsort(place)
                place, level = place[by], (levels(np.frombuffer(counts, np.int64)) - 1).astype(np.uint8)[by]
                bounds = np.searchsorted(place, np.arange(0, cells + 1, span))
                part = np.flatnonzero(np.diff(bounds))
                at = [(place[bounds[k] : bounds[k + 1]] - k * span).astype(np.int32).tobytes() for k in part]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(at, pa.binary()), pa.array([level[bounds[k] : bounds[k + 1]].tobytes() for k in part], pa.binary())], ["part", "at", "level"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()], pa.binary())], ["part", "cells"])
        for batch in batches:
            for part, at, level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield out()
                    now, held = part, np.full(span, _NEVER, np.uint8)
                np.minimum.at(held, np.frombuffer(at, np.int32), np.frombuffer(level, np.uint8))
        if now is not None:
            yield out()

    ranges = counted.select("tokens", "token_counts").mapInArrow(run, "part long, at binary, level binary").repartition("part").sortWithinPartitions("part")
    found = ranges.mapInArrow(least, "part long, cells binary").toArrow()
    table = np.full(cells, _NEVER, np.uint8)
    for part, some in zip(found["part"].to_pylist(), found["cells"].to_pylist(), strict=True):
        table[part * span :][: len(some)] = np.frombuffer(some, np.uint8)
    found = None
    tidy()
    return Contexts(table.tobytes(), distinct)


@dataclass
class Trained:
    """The written `token_counts` and `pair_filters`, how many shards there are (one without text has no row), and the contexts."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    contexts: Contexts


def trained(docs: DataFrame) -> Trained:
    """What all texts of `docs` (`text`) teach."""
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    counts = written(token_counts(texts, shards), "lm-tokens")
    contexts = contexts_of(counts)
    return Trained(counts, written(pair_filters(texts, shards, contexts), "lm-filters"), shards, contexts)


def train(docs: DataFrame, limit: int | None = None) -> Model | None:
    """The model of all texts of `docs` (`text`), or None if it has more than `limit` bytes."""
    return gathered(trained(docs), limit)


_COUNTS, _FILTERS = ("tokens", "token_counts"), ("filter", "raised", "raised_levels")


def _model_bytes(parts: Trained) -> int:
    """Looked at before anything is collected."""
    held = lambda rows, names: rows.agg(F.sum(sum((F.octet_length(c) for c in names[1:]), F.octet_length(names[0])))).first()[0] or 0
    return held(parts.counts, _COUNTS) + held(parts.filters, _FILTERS) + len(parts.contexts.cells)


def gathered(parts: Trained, limit: int | None = None) -> Model | None:
    """The shards' parts as one model, or None if they have more than `limit` bytes."""
    if _model_bytes(parts) > (BROADCAST_BYTES if limit is None else limit):
        return None
    # arrays of the sizes that are known are filled part by part, so the driver holds the model once
    key, count = np.empty(parts.contexts.distinct, np.uint64), np.empty(parts.contexts.distinct, np.int64)
    total = at = 0
    for r in parts.counts.toLocalIterator():
        n = len(r.tokens) // 8
        key[at : at + n], count[at : at + n] = np.frombuffer(r.tokens, np.uint64), np.frombuffer(r.token_counts, np.int64)
        total, at = total + r.total, at + n
    by = np.argsort(key)
    key = key[by].tobytes()
    count = (count.astype(np.uint32) if count.max(initial=0) < 1 << 32 else count)[by].tobytes()
    del by
    none = np.zeros(0, np.int64)
    empty = np.frombuffer(build_filter(none.astype(np.uint64), none, none)[0], np.uint8)
    own = {r.shard: r.n for r in parts.filters.select("shard", F.octet_length("filter").alias("n")).collect()}  # a number a shard
    ends = np.cumsum([own.get(k, len(empty)) for k in range(parts.shards)]).tolist()
    starts = [0, *ends[:-1]]
    # a bytearray, which goes into a broadcast without being copied
    whole, raised = bytearray(ends[-1]), [(np.zeros(0, np.uint64), np.zeros(0, np.uint8))]
    filters = np.frombuffer(whole, np.uint8)
    for k in set(range(parts.shards)) - own.keys():
        filters[starts[k] : ends[k]] = empty
    for r in parts.filters.toLocalIterator():
        filters[starts[r.shard] : ends[r.shard]] = np.frombuffer(r.filter, np.uint8)
        raised.append((np.frombuffer(r.raised, np.uint64), np.frombuffer(r.raised_levels, np.uint8)))
    pair, level = (np.concatenate(x) for x in zip(*raised, strict=True))
    order = np.argsort(pair)
    tidy()
    return Model(total, parts.contexts.distinct, key, count, whole, starts, parts.contexts, pair[order].tobytes(), level[order].tobytes())


@dataclass
class Piece(Model):
    """The shards from `first` on, as many as `starts` has, of a model of `shards`."""

    first: int = 0
    shards: int = 1

    def __reduce__(self):  # noqa: ANN204
        return Piece, (self.total, self.distinct, self.token_keys, self.token_counts, self.filters, self.starts, None, self.raised_keys, self.raised_levels, self.first, self.shards)

    def shard(self, key: np.ndarray) -> np.ndarray:
        return (key % _U(self.shards)).astype(np.int64) - self.first


def _piece(parts: Trained, first: int, end: int) -> Piece:
    """The shards from `first` to before `end`, as they were written."""
    own = (F.col("shard") >= first) & (F.col("shard") < end)
    counts, filters = (rows.where(own).toArrow() for rows in (parts.counts, parts.filters))
    key, count = (np.frombuffer(b"".join(counts[c].to_pylist()), kind) for c, kind in (("tokens", np.uint64), ("token_counts", np.int64)))
    by = np.argsort(key)
    held, none = dict(zip(filters["shard"].to_pylist(), filters["filter"].to_pylist(), strict=True)), np.zeros(0, np.int64)
    empty = build_filter(none.astype(np.uint64), none, none)[0]
    bits = [held.get(k, empty) for k in range(first, end)]
    raised, level = (np.frombuffer(b"".join(filters[c].to_pylist()), kind) for c, kind in (("raised", np.uint64), ("raised_levels", np.uint8)))
    order = np.argsort(raised)
    starts = [0, *np.cumsum([len(b) for b in bits[:-1]]).tolist()]
    count = count.astype(np.uint32) if count.max(initial=0) < 1 << 32 else count
    return Piece(0, 0, key[by].tobytes(), count[by].tobytes(), b"".join(bits), starts, None, raised[order].tobytes(), level[order].tobytes(), first, parts.shards)


def broadcast_pieces(parts: Trained, limit: int | None = None) -> list[Broadcast] | None:
    """The model in pieces of some PIECE_BYTES, each broadcast before the next is collected, or None if they have more than `limit` bytes."""
    if _model_bytes(parts) > (BROADCAST_BYTES if limit is None else limit):
        return None
    size = np.zeros(parts.shards, np.int64)
    for rows, names in ((parts.counts, _COUNTS), (parts.filters, _FILTERS)):
        for r in rows.select("shard", sum((F.octet_length(c) for c in names[1:]), F.octet_length(names[0])).alias("n")).collect():  # a number a shard
            size[r.shard] += r.n
    context, out, first = parts.counts.sparkSession.sparkContext, [], 0
    while first < parts.shards:
        end = first + max(1, int(np.searchsorted(np.cumsum(size[first:]), PIECE_BYTES, side="right")))
        end = min(end, parts.shards)
        out.append(context.broadcast(_piece(parts, first, end)))
        tidy()
        first = end
    return out


# --- scoring

_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _rows(part: pa.RecordBatch, model: Model, names: list[str]) -> pa.RecordBatch:
    got = model.score(*utf8(part.column("text")))
    out = [part.column("doc_id"), part.column("held_out"), got["n_tokens"], got["n_known"].astype(np.int64), np.full(part.num_rows, model.total, np.int64), got["base_score"], got["score"]]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)


@dataclass
class Pieced(Model):
    """A model whose shards are in several pieces; each token and pair is looked up in its own."""

    pieces: list[Piece] = field(default_factory=list)

    def _dealt(self, key: np.ndarray) -> Iterator[tuple[Piece, np.ndarray]]:
        shard = (key % _U(self.pieces[0].shards)).astype(np.int64)
        owner = np.searchsorted([p.first for p in self.pieces], shard, side="right") - 1
        by = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by], np.arange(len(self.pieces) + 1))
        return ((p, by[a:b]) for p, a, b in zip(self.pieces, cuts[:-1], cuts[1:], strict=True) if b > a)

    def token_count(self, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), np.int64)
        for piece, at in self._dealt(token):
            out[at] = piece.token_count(token[at])
        return out

    def pair_level(self, pair: np.ndarray, functions: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pair), np.int64)
        for piece, at in self._dealt(pair):
            out[at] = piece.pair_level(pair[at], functions[at])
        return out


def scored(docs: DataFrame, parts: Trained, pieces: list[Broadcast]) -> DataFrame:
    """`docs` (doc_id, held_out, text) scored with a broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(parts.contexts)  # _MOST_CELLS bytes at most
    total = parts.counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieced(total, shared.value.distinct, b"", b"", b"", [0], shared.value, pieces=[p.value for p in pieces])
        for batch in batches:
            for part in slices(batch, "text"):
                yield _rows(part, model, names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _RESULT)


#: Text bytes of a run, whose different tokens and pairs are asked about together.
RUN_BYTES = 8 << 20


@dataclass
class Answers(Model):
    """What the shards said about one run's tokens and pairs."""

    pairs: np.ndarray | None = None  # sorted, and their levels
    pair_levels: np.ndarray | None = None

    def pair_level(self, pair: np.ndarray, functions: np.ndarray) -> np.ndarray:
        return self.pair_levels[np.searchsorted(self.pairs, pair)].astype(np.int64)


def _asked(run: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A run's different tokens, its different pairs and a context of each, sorted by hash; and the order of tokens and of pairs by shard."""
    words, both, contexts = [], [], []
    for batch in run.select(["text"]).combine_chunks().to_batches():
        for part in slices(batch, "text"):
            token, before, _ = tokens(*utf8(part.column("text")))
            pair, first = np.unique(pairs(before, token), return_index=True)
            words.append(np.unique(token))
            both.append(pair)
            contexts.append(before[first])
    token = np.unique(np.concatenate(words))
    pair, first = np.unique(np.concatenate(both), return_index=True)
    return token, pair, np.concatenate(contexts)[first], [np.argsort(x % _U(shards), kind="stable") for x in (token, pair)]


def scored_by_shards(docs: DataFrame, parts: Trained) -> DataFrame:
    """`docs` (doc_id, held_out, text) scored without a broadcast model. Each run of texts asks the shards about its different tokens and
    pairs, in one binary a shard, and meets their answers again: 8 bytes a token or pair go out, and a count or level of few comes back."""
    shards, shared = parts.shards, docs.sparkSession.sparkContext.broadcast(parts.contexts)  # _MOST_CELLS bytes at most
    total = parts.counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = docs.select("doc_id", "held_out", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // RUN_BYTES)))).alias("run"))
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def ask(run: pa.Table) -> pa.Table:
        token, pair, context, (by_token, by_pair) = _asked(run, shards)
        columns = [token[by_token], pair[by_pair], shared.value.functions(context).astype(np.uint8)[by_pair]]
        dealt = [(x % _U(shards)).astype(np.int64) for x in columns[:2]]
        own = np.union1d(*dealt)
        cuts = [np.stack([np.searchsorted(x, own), np.searchsorted(x, own, side="right")], 1).tolist() for x in (dealt[0], dealt[1], dealt[1])]
        out = [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x, cut in zip(columns, cuts, strict=True)]
        tidy()
        return pa.table([pa.array(np.full(len(own), run.column("run")[0].as_py())), pa.array(own.astype(np.int32)), *out], ["run", "shard", "ask_tokens", "ask_pairs", "functions"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = -1, None
        for batch in batches:
            out = []
            for run, shard, *asked, keys, counts, filters, raised, raised_levels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    now, model = shard, Model(0, 0, b"", b"", b"", [0])
                if run is None:  # what a shard knows comes before what it is asked
                    filled = lambda new, old: old if new is None else new
                    model = Model(0, 0, filled(keys, model.token_keys), filled(counts, model.token_counts), filled(filters, model.filters), [0], None, filled(raised, model.raised_keys), filled(raised_levels, model.raised_levels))
                    continue
                token, pair = (np.frombuffer(x, np.uint64) for x in asked[:2])
                level = model.pair_level(pair, np.frombuffer(asked[2], np.uint8).astype(np.int64)) if len(pair) else np.zeros(0, np.int64)
                out.append((run, shard, model.token_count(token).tobytes(), level.astype(np.uint8).tobytes()))
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["run", "shard", "counts", "levels"])

    def score(run: pa.Table, answers: pa.Table) -> pa.Table:
        token, pair, _, (by_token, by_pair) = _asked(run, shards)
        answers = answers.sort_by("shard")
        count, level = np.empty(len(token), np.int64), np.empty(len(pair), np.uint8)
        count[by_token] = np.frombuffer(b"".join(answers.column("counts").to_pylist()), np.int64)
        level[by_pair] = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)
        model = Answers(total, shared.value.distinct, token.tobytes(), count.tobytes(), b"", [0], shared.value, pairs=pair, pair_levels=level)
        out = [_rows(part, model, names) for batch in run.combine_chunks().to_batches() for part in slices(batch, "text")]
        return pa.Table.from_batches(out)

    none = lambda kind, *cs: [F.lit(None).cast(kind).alias(c) for c in cs]
    asks = runs.groupBy("run").applyInArrow(ask, "run long, shard int, ask_tokens binary, ask_pairs binary, functions binary")
    rows = asks.select("*", *none("binary", "tokens", "token_counts", "filter", "raised", "raised_levels"))
    blank = [*none("long", "run"), F.col("shard"), *none("binary", "ask_tokens", "ask_pairs", "functions")]
    rows = rows.union(parts.counts.select(*blank, "tokens", "token_counts", *none("binary", "filter", "raised", "raised_levels")))
    rows = rows.union(parts.filters.select(*blank, *none("binary", "tokens", "token_counts"), "filter", "raised", "raised_levels"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("run").isNotNull())
    answers = rows.mapInArrow(answer, "run long, shard int, counts binary, levels binary")
    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(score, _RESULT)


def scored_by_joins(docs: DataFrame) -> DataFrame:
    """Scores by exact counts, without a filter: a row per text and distinct pair, joined with the pair's probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                token, before, begin = tokens(*utf8(part.column("text")))
                row = np.repeat(np.arange(part.num_rows), np.diff(begin))
                order = np.lexsort((pairs(before, token), row))
                pair, row, before, token = pairs(before, token)[order], row[order], before[order], token[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])]))
                n = np.diff(np.append(new, len(pair)))
                take = pa.array(row[new])
                out = [part.column("row").take(take), part.column("held_out").take(take), *(pa.array(x[new].view(np.int64)) for x in (before, token, pair)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(out, ["row", "held_out", "u", "w", "pair", "n"])

    numbered = written(docs.select("doc_id", "held_out", "text").withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    rows = written(numbered.select("row", "held_out", "text").mapInArrow(run, "row long, held_out boolean, u long, w long, pair long, n long"), "lm-pairs")
    seen = rows.groupBy("pair", "u", "w").agg(F.sum(F.when(~F.col("held_out"), F.col("n")).otherwise(0)).alias("c2"))
    seen = seen.withColumn("level", F.when(F.col("c2") > 0, F.floor(F.log2("c2") + 1e-12) + 1).otherwise(0))
    seen = written(seen, "lm-counts")
    token = seen.groupBy("w").agg(F.sum("c2").alias("c"))
    context = seen.groupBy("u").agg(F.sum("c2").alias("cu"))
    total, distinct = token.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    base = (F.col("c") + 1) / F.lit(float(total + distinct + 1))
    count = F.when(F.col("level") > 0, F.pow(F.lit(2.0), F.col("level") - 1)).otherwise(0.0)
    mass = MASS * F.pow(F.greatest(F.col("cu"), F.lit(1)).cast("double"), F.lit(POWER))
    p = (F.least(count, F.col("cu").cast("double")) + mass * base) / (F.col("cu") + mass)  # a pair is no more frequent than its context
    scored_pairs = seen.join(token, "w").join(context, "u").select("pair", (F.col("c") > 0).cast("long").alias("known"), F.log10(base).alias("base"), F.log10(p).alias("score"))
    sums = rows.select("row", "pair", "n").join(scored_pairs, "pair").groupBy("row").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("known")).alias("n_known"), F.sum(F.col("n") * F.col("base")).alias("base_score"), F.sum(F.col("n") * F.col("score")).alias("score"))
    return numbered.select("row", "doc_id", "held_out").join(sums, "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` per row of `docs` (doc_id, text, any others).

    The model learns from the rows that aren't held out. A null text counts as empty, and has its end as only
    token; a null doc_id is in the training fold or not as an empty one would be. Repeated rows count and
    are scored each. With no training text, every count is 0 and an unseen token has probability 1. A model of more than
    `broadcast_bytes` is probed shard by shard, with equal scores; 0 asks for exact counts instead of the filter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if broadcast_bytes == 0:
        return scored_by_joins(rows)
    parts = trained(rows.where(~F.col("held_out")))
    pieces = broadcast_pieces(parts, broadcast_bytes)
    return scored_by_shards(rows, parts) if pieces is None else scored(rows, parts, pieces)

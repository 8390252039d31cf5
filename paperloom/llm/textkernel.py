"""Vectorised text kernels over Arrow string buffers.

Words are found on UTF-8 bytes: every separator class used here is ASCII, and no byte of a
multi-byte code point is ASCII, so byte classes and code point classes agree.
Nothing in here depends on the size of a partition: callers feed slices of bounded bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call works on; a longer document makes a slice of its own.
SLICE_BYTES = 2 << 20

# The XXH64 constants.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)
_U = np.uint64


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte that belongs to a word."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = lambda _: 0


def tidy() -> None:
    """Gives memory that is free back to the system: workers are kept for later stages, and share their machine with those."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `limit` bytes; a longer text is a run alone. After the last, `tidy`."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    tidy()


class Words:
    """The words of a run of texts: `start` and `end` in `data`, and `first`, each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = table[self.data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with one space after each word that isn't its text's last, and the words' new bounds."""
        keep = self.inside.copy()
        nxt = self.end[:-1][self.end[:-1] < self.start[1:]] if len(self) else self.end
        keep[nxt] = True
        data = np.where(self.inside, self.data, np.uint8(32))[keep]
        place = np.cumsum(keep) - 1
        return data, place[self.start], place[self.end - 1] + 1


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


#: Longer spans are hashed one by one.
_LONG = 1024


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42, block: int = 1 << 16) -> np.ndarray:
    """XXH64 of each span data[start:end]."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(start), block):
            out[at : at + block] = _xxh64(padded, start[at : at + block].astype(np.int64), end[at : at + block].astype(np.int64), _U(seed))
    return out


def _xxh64(data: np.ndarray, pos: np.ndarray, end: np.ndarray, seed: np.uint64) -> np.ndarray:
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    halves = np.ndarray((len(data) - 3,), dtype="<u4", buffer=data, strides=(1,))
    size = end - pos
    h = np.full(len(pos), seed + _P5, np.uint64)
    pos = pos.copy()
    striped = np.flatnonzero((size >= 32) & (size <= _LONG))
    if len(striped):
        p, stop = pos[striped], end[striped]
        acc = [np.full(len(p), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        live = np.arange(len(p))
        while len(live):
            q = p[live]
            for i in range(4):
                acc[i][live] = _round(acc[i][live], words[q + 8 * i])
            p[live] = q + 32
            live = live[p[live] + 32 <= stop[live]]
        x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[striped], pos[striped] = x, p
    h += size.astype(np.uint64)
    far = np.flatnonzero(size > _LONG)
    pos[far] = end[far]
    live = np.flatnonzero(pos + 8 <= end)
    while len(live):
        q = pos[live]
        h[live] = _rotl(h[live] ^ _round(np.zeros(len(live), np.uint64), words[q]), 27) * _P1 + _P4
        pos[live] = q + 8
        live = live[q + 16 <= end[live]]
    live = np.flatnonzero(pos + 4 <= end)
    if len(live):
        q = pos[live]
        h[live] = _rotl(h[live] ^ (halves[q].astype(np.uint64) * _P1), 23) * _P2 + _P3
        pos[live] = q + 4
    live = np.flatnonzero(pos < end)
    while len(live):
        q = pos[live]
        h[live] = _rotl(h[live] ^ (data[q].astype(np.uint64) * _P5), 11) * _P1
        pos[live] = q + 1
        live = live[q + 1 < end[live]]
    h ^= h >> _U(33)
    h *= _P2
    h ^= h >> _U(29)
    h *= _P3
    h ^= h >> _U(32)
    if len(far):
        import xxhash

        start = end - size
        for i in far:
            h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), int(seed))
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's word shingles, repeats included, words lower-cased and joined by a space;
    a text of fewer words has its whole sequence as the only shingle. Also where each text's begin."""
    words = Words(data, offsets)
    count = words.counts
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
    joined, start, end = words.joined()
    n = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    head = words.first[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    last = np.minimum(head + size, words.first[1:][row]) - 1
    return xxh64(joined, start[head], end[last], seed), begin

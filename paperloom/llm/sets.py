"""Sets of shingles held against each other in a task."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Sets:
    """Shingle sets that others are held against: all shingles sorted, with the set that each is of."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.threshold = threshold
        self.size = np.array([len(x) for x in sets], np.int64)
        shingles = np.concatenate([np.zeros(0, np.int64), *sets])
        by = np.argsort(shingles, kind="stable")
        self.shingles, self.of = shingles[by], np.repeat(np.arange(len(sets)), self.size)[by]

    def similar(self, shingles: np.ndarray) -> np.ndarray:
        """Which sets are as similar to this one as asked, by Jaccard; two empty ones are."""
        low = np.searchsorted(self.shingles, shingles)
        n = np.searchsorted(self.shingles, shingles, side="right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.of[at], minlength=len(self.size))
        return shared >= self.threshold * (self.size + len(shingles) - shared)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Each run of rows with equal keys, whole."""
    held: list[pa.RecordBatch] = []
    now = None
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        for a, b in itertools.pairwise(cut.tolist()):
            if held and tuple(key[a]) != now:
                yield whole()
                held = []
            now = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def arrays(lists: pa.Array) -> list[np.ndarray]:
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return [values[i:j] for i, j in itertools.pairwise(lists.offsets.to_numpy().tolist())]

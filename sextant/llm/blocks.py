"""Groups of bounded size from sorted Arrow batches, and union-find inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table, from batches sorted by the keys (columns of integers without null)."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for i, j in zip(at[:-1], at[1:], strict=True):
            here = tuple(k[i])
            if kept and here != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = here
            kept.append(batch.slice(i, j - i))
    if kept:
        yield pa.Table.from_batches(kept)


class Forest:
    """Union-find over 0..n-1 that knows which unions joined two trees."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> bool:
        a, b = self.label[i], self.label[j]
        if a == b:
            return False
        self.label[self.label == max(a, b)] = min(a, b)
        return True

    def stars(self, ids: np.ndarray) -> np.ndarray:
        """Each tree of two or more as edges from its smallest id: the same for any order of unions, so that the trees
        that other blocks find in a group come out as the same few edges."""
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, self.label, ids)
        low = low[self.label]
        return np.stack([low, ids], axis=1)[low != ids]

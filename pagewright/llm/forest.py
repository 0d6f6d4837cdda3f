"""Array helpers for tasks that compare rows in tiles: spanning links, and whole runs out of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def flattened(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join the trees of all linked pairs. Returns the new parents and the pairs that joined two trees."""
    left, right = [], []
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
        _, pick = np.unique(hi, return_index=True)  # a root is hung once a round
        parent[hi[pick]] = lo[pick]
        left.append(a[pick])
        right.append(b[pick])
        parent = flattened(parent)
    none = np.empty(0, np.int64)
    return parent, np.concatenate([none, *left]), np.concatenate([none, *right])


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int, to_arrays) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of a partition sorted by its first ``keys`` columns, regrouped so that no run of equal keys is split."""
    rest = None
    for batch in batches:
        columns = to_arrays(batch)
        if not len(columns[0]):
            continue
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns)]
        other = np.any([c[:-1] != c[-1] for c in columns[:keys]], axis=0)
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield tuple(c[:cut] for c in columns)
        rest = [c[cut:] for c in columns]
    if rest is not None and len(rest[0]):
        yield tuple(rest)


def run_bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return np.concatenate(([0], change)), np.concatenate((change, [len(keys[0])]))

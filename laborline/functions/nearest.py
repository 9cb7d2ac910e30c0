"""The rows of a block that are nearest to each query of another by cosine, in numpy: products of single floats leave few
pairs out of doubt, and these are scored as similarity.cosine does, entry by entry in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products that are held at once, and pairs that are scored at once.
_PRODUCTS, _PAIRS = 1 << 21, 1 << 16


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length; under -1 those that are null or have a null in them."""
    lists = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    sizes = np.maximum(lengths, 0)
    starts = np.cumsum(sizes) - sizes
    if flat.null_count:
        lengths[np.repeat(np.arange(len(lengths)), sizes)[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
        flat = pc.fill_null(flat, 0)
    values, out = flat.to_numpy(zero_copy_only=False).astype(np.float64), {}
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        out[length] = places, values[starts[places][:, None] + np.arange(max(0, length))]
    return out


class _Block:
    """Vectors of one length: ``by_entry`` (entry, vector), their norms, single floats of length 1, and whether a norm is beyond what these can stand for."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.by_entry = np.ascontiguousarray(vectors.T)
        square = np.zeros(len(vectors))
        for x in self.by_entry:
            square += x * x
        self.norms = np.sqrt(square)
        self.odd = ~((self.norms == 0) & ~vectors.any(axis=1) | (self.norms > 1e-100) & (self.norms < 1e100))
        self.units = (vectors / np.where(self.odd | (self.norms == 0), np.inf, self.norms)[:, None]).astype(np.float32)
        self.units[self.odd] = 0


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors that have fewer than ``k`` equal ones before them."""
    if not vectors.size:
        return np.arange(min(k, len(vectors)))
    keys = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    same = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    begins = np.flatnonzero(np.diff(same[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
    return np.sort(order[nth < k])


def _candidates(rows: _Block, asked: _Block, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of queries, and pairs (query, row) with every row that may be one of a query's ``k`` best."""
    n, dimension = rows.units.shape
    slack = 2 * (dimension + 8) * 2.0**-24  # twice the most that a product of single floats is off
    groups = min(n, max(512, 16 * k))
    step = max(1, _PRODUCTS // max(1, n))
    by_entry, odd = np.ascontiguousarray(rows.units.T), np.flatnonzero(rows.odd)
    for lo in range(0, len(asked.units), step):
        near = asked.units[lo : lo + step] @ by_entry
        near[:, odd] = -np.inf
        least = np.full(len(near), -np.inf, np.float32)
        if n >= k:  # the best of disjoint groups: the k-th of them is no better than the k-th of all
            best = near[:, : n // groups * groups].reshape(len(near), -1, groups).max(axis=1)
            least = np.partition(best, groups - k, axis=1)[:, groups - k] - np.float32(slack)
        maybe = near >= least[:, None]
        maybe[:, odd] = True
        maybe[asked.odd[lo : lo + step]] = True
        q, r = np.divmod(np.flatnonzero(maybe), max(1, n))
        yield np.arange(lo, lo + len(near)), q + lo, r


def _cosines(rows: _Block, asked: _Block, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.empty(len(q))
    for lo in range(0, len(q), _PAIRS):
        i, j = r[lo : lo + _PAIRS], q[lo : lo + _PAIRS]
        total = np.zeros(len(i))
        for x, y in zip(rows.by_entry, asked.by_entry, strict=True):
            total += x[i] * y[j]
        length = rows.norms[i] * asked.norms[j]
        out[lo : lo + _PAIRS] = np.where(length == 0, 0.0, total / length)
    return out


def _best(q: np.ndarray, r: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best, not-a-numbers before all others, ties by row."""
    none = np.isnan(score)
    order = np.lexsort((r, np.where(none, 0, -score), ~none, q))
    begins = np.flatnonzero(np.diff(q[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
    return order[nth < k]


def nearest(rows: pa.ChunkedArray, queries: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row, score: places of each query's ``k`` nearest rows, of which earlier ones come first where scores are equal.

    Scores are those of similarity.cosine: zero for vectors of no length, of different lengths, or with nulls.
    """
    nothing = np.zeros(0, np.int64)
    by_length, found = {}, [(nothing, nothing, np.zeros(0))]
    for length, (places, vectors) in _by_length(rows).items():
        kept = _first_copies(vectors, k)
        by_length[length] = places[kept], _Block(vectors[kept])
    with np.errstate(all="ignore"):
        for length, (own, vectors) in _by_length(queries).items():
            alike = by_length.get(length) if length >= 0 else None
            places, block = alike or (nothing, _Block(vectors[:0]))
            asked = _Block(vectors)
            # All other rows score zero: the first k of them are enough.
            zeros = np.sort(np.concatenate([nothing, *(x[0] for x in by_length.values() if x is not alike)]))[:k]
            for batch, q, r in _candidates(block, asked, k):
                score = np.concatenate([_cosines(block, asked, q, r), np.zeros(len(batch) * len(zeros))])
                q, r = np.concatenate([q, np.repeat(batch, len(zeros))]), np.concatenate([places[r], np.tile(zeros, len(batch))])
                top = _best(q, r, score, k)
                found.append((own[q[top]], r[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))

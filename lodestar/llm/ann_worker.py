"""Collision counting over the sorted projections of one shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrow import give_back

#: First half width of a window, for vectors of length 1, and its growth; queries whose windows are looked up together.
START, GROWTH, TOGETHER = 1.0, 1.05, 256


def projections(seed: int, dim: int, m: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


class Shard:
    """Vectors scaled to length 1, where the nearest by distance are those of the largest cosine, and m sorted projections of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int, seed: int):
        self.ids, self.vectors = ids, vectors
        self.length = np.sqrt((vectors * vectors).sum(1))
        self.axes = projections(seed, vectors.shape[1], m)
        spots = (vectors / self.length[:, None]) @ self.axes
        order = np.argsort(spots, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(spots, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)

    def windows(self, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each query's window in each sorted projection."""
        low, high = (np.stack([np.searchsorted(v, c) for v, c in zip(self.values, (centre + side).T)], axis=1) for side in (-radius, radius))
        return low, high

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float, extra: float):
        """The k nearest of the shard for each query, as (query's index, row's index, cosine), and the entries that windows touched.

        A query's windows grow round its own projections, step by step, and each vector that a window newly reaches
        counts a collision. The search ends when ``k + extra * rows`` vectors have collided ``threshold * m`` times, or
        all windows hold everything; all vectors past the threshold are verified.
        """
        n, m = len(self.ids), len(self.values)
        need, enough = int(np.ceil(threshold * m)), k + int(np.ceil(extra * n))
        out, touched = [], 0
        for first in range(0, len(queries), TOGETHER):
            some = queries[first : first + TOGETHER]
            size = np.sqrt((some * some).sum(1))
            centre = (some / size[:, None]) @ self.axes
            own_ids = query_ids[first : first + TOGETHER]
            counts: dict[int, np.ndarray] = {}
            active, radius = np.arange(len(some)), START
            lo = hi = None
            while len(active):
                low, high = self.windows(centre[active], radius)
                if lo is not None:
                    low, high = np.minimum(low, lo), np.maximum(high, hi)
                going = []
                for i, at in enumerate(active.tolist()):
                    if lo is None:
                        parts = [o[x:y] for o, x, y in zip(self.order, low[i].tolist(), high[i].tolist())]
                    else:
                        parts = [o[x:y] for o, x, y in zip(self.order, low[i].tolist(), lo[i].tolist())]
                        parts += [o[x:y] for o, x, y in zip(self.order, hi[i].tolist(), high[i].tolist())]
                    met = np.concatenate(parts)
                    touched += len(met)
                    now = np.bincount(met, minlength=n)
                    now = counts[at] = now + counts[at] if at in counts else now
                    whole = not low[i].any() and (high[i] == n).all()
                    own = self.ids == own_ids[at]
                    found = np.flatnonzero(~own & (whole | (now >= need)))
                    if len(found) < min(enough, n - int(own.sum())) and not whole:
                        going.append(i)
                        continue
                    del counts[at]
                    near = self.vectors[found] @ some[at] / self.length[found]
                    if len(found) > k:  # what is within rounding of the k nearest is measured exactly
                        found = found[near >= np.partition(near, -k)[-k] - 1e-9 * size[at]]
                    score = (self.vectors[found] * some[at]).sum(1) / (self.length[found] * size[at])
                    keep = np.lexsort((self.ids[found], -score))[:k]
                    out += [(first + at, int(found[j]), float(score[j])) for j in keep]
                active, lo, hi = active[going], low[going], high[going]
                radius *= GROWTH
        return out, touched


def search(ids, vectors, query_ids, queries, k: int, m: int, threshold: float, extra: float, seed: int):
    """`Shard.search` of one shard's vectors."""
    return Shard(ids, vectors, m, seed).search(query_ids, queries, k, threshold, extra)[0]


def shards(batches, rows: int):
    """(ids, vectors) of one length of vector, of up to so many rows, from Arrow batches (vec_id, v)."""
    held: dict[int, list] = {}
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("v")
        sizes = np.asarray(lists.value_lengths())
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for dim in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dim)
            new = (ids[own], flat[(starts[own][:, None] + np.arange(dim))])
            kept = held.setdefault(dim, [])
            kept.append(new)
            if sum(len(x[0]) for x in kept) >= rows:
                ids_, vectors = (np.concatenate(x) for x in zip(*kept))
                full = len(ids_) // rows * rows
                for at in range(0, full, rows):
                    yield ids_[at : at + rows], vectors[at : at + rows]
                held[dim] = [(ids_[full:], vectors[full:])]
    for kept in held.values():
        if sum(len(x[0]) for x in kept):
            yield tuple(np.concatenate(x) for x in zip(*kept))


def search_batches(sent, rows: int, k: int, m: int, threshold: float, extra: float, seed: int):
    """Columns in: vec_id, v. Out: query_row, query_id, vec_id, score of the k nearest of each shard to each query sent, by length of vector."""

    def run(batches):
        asked = sent.value
        for ids, vectors in shards(batches, rows):
            marks, qids, queries = asked.get(vectors.shape[1], ((), (), ()))
            if not len(marks):
                continue
            found = search(ids, vectors, qids, queries, k, m, threshold, extra, seed)
            q, i, score = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)
            yield pa.RecordBatch.from_arrays([pa.array(marks[q]), pa.array(qids[q]), pa.array(ids[i]), pa.array(score)], ["query_row", "query_id", "vec_id", "score"])
        give_back()

    return run

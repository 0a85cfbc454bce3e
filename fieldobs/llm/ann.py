"""Approximate nearest neighbours by collision-counting hashing.

Each of ``projections`` random directions gives one hash function, kept as one sorted array of
the block's projected vectors. A query looks at a window around its own projection in every
array and widens all windows step by step (virtual rehashing: a wider window is a coarser
bucket centred on the query; only its newly covered ends are read). A vector collides once per
window that covers it; those with at least ``threshold`` of all possible collisions are verified
by their exact cosine. The search stops once the windows are so wide that a vector as near as
the k-th best found would have collided that often with a margin of ``margin`` deviations.

Vectors are scaled to length one first, where the nearest by angle is the nearest by distance,
so a projected difference is a normal variable of that distance. There is no limit on the number
of candidates; every row is indexed, and the scores are computed from the original vectors.

Defined cases: rows without an id and vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do those of another than the usual length; repeated
rows count once; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fieldobs.llm.cells import best_of_cells, usable


def _normal_quantile_of_abs(p: float) -> float:
    """x with P(|N(0, 1)| <= x) = p, by bisection."""
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


class SortedProjections:
    """One sorted array per projection of a block of unit vectors."""

    def __init__(self, units: np.ndarray, directions: np.ndarray):
        self.values = np.ascontiguousarray((units @ directions).T)
        self.order = np.argsort(self.values, axis=1, kind="stable")
        self.values = np.take_along_axis(self.values, self.order, 1)

    def windows(self, centres: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, projection and half-width: where the window begins and ends."""
        shape = (*centres.shape, len(widths))
        low, high = np.empty(shape, np.int64), np.empty(shape, np.int64)
        for j, values in enumerate(self.values):
            low[:, j] = np.searchsorted(values, centres[:, j, None] - widths, "left")
            high[:, j] = np.searchsorted(values, centres[:, j, None] + widths, "right")
        return low, high


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 projections: int, threshold: float, margin: float, growth: float) -> pd.DataFrame:
    norms, query_norms = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    directions = np.random.default_rng(5).normal(size=(vectors.shape[1], projections))
    index = SortedProjections(vectors / norms[:, None], directions)
    # Half-widths from nearly empty windows up to such that any two unit vectors collide.
    widths = np.geomspace(0.2, 2 * _normal_quantile_of_abs(0.9999), 1 + math.ceil(math.log(39, growth)))
    needed = math.ceil(threshold * projections)
    sure = min(threshold + margin * math.sqrt(threshold * (1 - threshold) / projections), 0.999)
    reach = _normal_quantile_of_abs(sure)  # half-width, in distances, that collides often enough for sure
    out = []
    for at in range(0, len(queries), 64):
        part = slice(at, at + 64)
        units = queries[part] / query_norms[part, None]
        low, high = index.windows(units @ directions, widths)
        for q, (query_id, vector, norm) in enumerate(zip(query_ids[part], queries[part], query_norms[part])):
            collisions, verified = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
            verified[ids == query_id] = True
            found, scores = np.empty(0, np.int64), np.empty(0)
            last_low, last_high = low[q, :, 0], low[q, :, 0]
            for step, width in enumerate(widths):
                now_low, now_high = low[q, :, step], high[q, :, step]
                ends = [o[a:b] for o, a, b in zip(index.order, now_low, last_low)]
                ends += [o[a:b] for o, a, b in zip(index.order, last_high, now_high)]
                collisions += np.bincount(np.concatenate(ends), minlength=len(ids))
                last_low, last_high = now_low, now_high
                fresh = np.flatnonzero((collisions >= needed) & ~verified)
                if len(fresh):
                    verified[fresh] = True
                    found = np.concatenate([found, fresh])
                    scores = np.concatenate([scores, vectors[fresh] @ vector / (norms[fresh] * norm)])
                    best = np.lexsort((ids[found], -scores))[:k]
                    found, scores = found[best], scores[best]
                    if len(found) == k and width >= reach * math.sqrt(max(2 - 2 * scores[-1], 0.0)):
                        break
                elif len(found) == k and width >= reach * math.sqrt(max(2 - 2 * scores[-1], 0.0)):
                    break
            if len(found) < k:  # fewer than k collided even in the widest windows
                rest = np.flatnonzero(~verified)
                found = np.concatenate([found, rest])
                scores = np.concatenate([scores, vectors[rest] @ vector / (norms[rest] * norm)])
                best = np.lexsort((ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found], "score": scores}))
    return pd.concat(out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
            projections: int = 96, threshold: float = 0.6, margin: float = 2.0, growth: float = 1.15,
            block_rows: int = 16_384, chunk_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest by cosine to each row of ``queries``, but those of its own id.

    Returns query_id, rank (from 1), vec_id, score.
    """
    def search(ids, rows, query_ids, asked):
        return search_block(ids, rows, query_ids, asked, k, projections, threshold, margin, growth)

    base, asked = usable(vectors, id_col, vector, False), usable(queries, id_col, vector, False)
    return best_of_cells(base, asked, k, "double", block_rows, chunk_rows, search)

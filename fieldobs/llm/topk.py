"""Exact top-k inner products by the threshold algorithm.

A block keeps one list per dimension, sorted by that component. A query reads the lists of its
positive weights from the top and of its negative ones from the bottom, all to the same depth;
every row met gets its full score at once. Rows not met so far can't beat the threshold, the
score of a row that had the last value read in every list; the query is done when its k-th best
is above it. Depth doubles from round to round, and the queries of a chunk share the rounds, so
that the random accesses of a round are one matrix product over the rows newly met.

Defined cases: rows without an id and vectors that are null, empty or hold null or non-finite
components take no part, nor do those of another than the usual length; repeated rows count
once; with fewer than k candidates all are returned; ties go to the smaller id; an empty table
gives no rows. Scores are integers; they are exact while they stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.llm.cells import best_of_cells, usable


class SortedLists:
    """Per dimension, the rows of a block by rising component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, 0)

    def met(self, start: int, stop: int) -> np.ndarray:
        """Rows that stand from ``start`` to ``stop`` at either end of some list."""
        n = len(self.order)
        ends = [self.order[start:stop].ravel(), self.order[max(n - stop, 0):n - start].ravel()]
        return np.unique(np.concatenate(ends))

    def threshold(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """The highest score of a row below ``depth`` in every list that the query reads."""
        n = len(self.order)
        top, bottom = self.values[max(n - depth, 0)], self.values[min(depth, n) - 1]
        return np.where(queries > 0, queries * top, queries * bottom).sum(1)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 first_depth: int = 16) -> pd.DataFrame:
    lists, out = SortedLists(vectors), []
    for at in range(0, len(queries), 256):
        q_ids, asked = query_ids[at:at + 256], queries[at:at + 256]
        seen, active = np.zeros(len(ids), bool), np.arange(len(q_ids))
        best = pd.DataFrame({"q": np.empty(0, np.int64), "row": np.empty(0, np.int64), "score": np.empty(0)})
        kth = np.full(len(q_ids), -np.inf)
        start, depth = 0, first_depth
        while len(active) and start < len(ids):
            new = lists.met(start, min(depth, len(ids)))
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                scores = asked[active] @ vectors[new].T
                scores[q_ids[active, None] == ids[new]] = -np.inf
                bar = kth[active]
                if len(new) > k:
                    bar = np.maximum(bar, np.partition(scores, len(new) - k, axis=1)[:, len(new) - k])
                q, row = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
                best = pd.concat([best, pd.DataFrame({"q": active[q], "row": new[row], "score": scores[q, row]})])
                best = best.iloc[np.lexsort((ids[best["row"]], -best["score"], best["q"]))]
                best = best[best.groupby("q").cumcount() < k]
                held = best.groupby("q")["score"].agg(["min", "size"])
                full = held[held["size"] == k]
                kth[full.index] = full["min"]
            bound = lists.threshold(asked[active], min(depth, len(ids)))
            active = active[~(kth[active] > bound)]
            start, depth = min(depth, len(ids)), depth * 2
        out.append(pd.DataFrame({"query_id": q_ids[best["q"]], "vec_id": ids[best["row"]],
                                 "score": best["score"].to_numpy().astype(np.int64)}))
    return pd.concat(out)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
                 vector: str = "embedding", block_rows: int = 16_384, chunk_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product with each of ``queries``, but those of its own id.

    Components x count as floor(scale * x). Returns query_id, rank (from 1), vec_id, score.
    """
    def whole(df: DataFrame) -> DataFrame:
        steps = usable(df, id_col, vector, True)
        return steps.select("id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"))

    def search(ids, rows, query_ids, asked):
        return search_block(ids, rows, query_ids, asked, k)

    return best_of_cells(whole(vectors), whole(queries), k, "long", block_rows, chunk_rows, search)

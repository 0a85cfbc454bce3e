"""Blocked search of a query set against a table of vectors.

Vectors are dealt into blocks and queries into chunks by hash; a cell is one block with one
chunk, and every cell is one group of a co-grouped map. A cell's memory and work are bounded by
``block_rows`` and ``chunk_rows`` whatever the table's size; nothing is broadcast. Each cell
returns its best rows for every query, and a window over those (``k`` a block) ranks them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldobs.llm.common import blocks_for


def usable(df: DataFrame, id_col: str, vector: str, allow_zero: bool) -> DataFrame:
    """(id, vector) as long and array<double>: rows with an id and a full, finite vector of the usual length.

    The usual length is the most frequent one, the smaller in a tie. Repeated rows count once.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~bad)
    if not allow_zero:
        whole = whole.where(F.exists("vector", lambda x: x != 0.0))
    usual = whole.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return whole.where(F.size("vector") == (usual["n"] if usual else 0)).dropDuplicates(["id", "vector"])


def matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vector"].to_numpy()).astype(float) if len(frame) else np.empty((0, 0))


def best_of_cells(base: DataFrame, queries: DataFrame, k: int, score: str, block_rows: int, chunk_rows: int,
                  search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """The ``k`` best rows of ``base`` for each of ``queries``, both (id, vector).

    ``search(ids, vectors, query_ids, query_vectors)`` gives a cell's best as query_id, vec_id,
    score. A row is no candidate for a query of the same id. Ties go to the smaller id.
    """
    blocks, chunks = blocks_for(base.count(), block_rows), blocks_for(queries.count(), chunk_rows)
    # Every row meets each chunk, every query each block.
    base = base.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("chunk", _every(chunks))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(chunks))).withColumn("block", _every(blocks))

    def cell(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows, asked = rows.sort_values("id", kind="stable"), asked.sort_values("id", kind="stable")
        return search(rows["id"].to_numpy(np.int64), matrix(rows), asked["id"].to_numpy(np.int64), matrix(asked))

    keys = ["block", "chunk"]
    found = base.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(cell, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

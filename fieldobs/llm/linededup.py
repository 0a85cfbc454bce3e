"""Line de-duplication by overlapping three-line windows, in SQL functions only.

Every window of three consecutive lines is hashed. Windows that occur again anywhere in the
corpus are found by one aggregate per hash; the occurrence with the smallest (document,
position) stays and every later one covers its lines. Covered positions are merged per
document and those lines are removed. A passage that repeats is thus removed as a whole,
whatever stands before and after it, while a single common line stays.

Defined cases: a text of under three lines has no window; a window of three blank lines takes
no part; a later occurrence that overlaps the first one in the same document covers only the
lines behind the first one. A null text stays null, an empty one empty. Rows repeated with
the same id and text are one document: both lose the same lines. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = 3
OWN = "__linededup"


def windows(lines: Column, n: int = LINES) -> Column:
    """Array of (pos, hash) of the overlapping windows of ``n`` lines."""
    size = F.size(lines)

    def window(pos: Column) -> Column:
        part = F.slice(lines, pos + 1, n)
        text = F.concat_ws("\n", part)
        return F.struct(pos.alias("pos"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"),
                        F.exists(part, lambda x: F.trim(x) != "").alias("filled"))

    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), window))


def repeated_lines(docs: DataFrame, n: int = LINES) -> DataFrame:
    """(doc_id, text_hash, removed): the sorted positions each document loses; only documents that lose any."""
    read = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.split("text", "\n", -1).alias("lines"))
    each = read.select("doc_id", "text_hash", F.explode(windows(F.col("lines"), n)).alias("w")).select(
        "doc_id", "text_hash", "w.pos", "w.h1", "w.h2", "w.filled").where("filled")
    place = F.struct("doc_id", "text_hash", "pos")
    # Per hash and task one row goes on, so a window in a third of all documents is no hot key.
    first = each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    later = each.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
    start = F.when(same, F.greatest(F.col("pos"), F.col("first.pos") + n)).otherwise(F.col("pos"))
    covered = later.select("doc_id", "text_hash", F.explode(F.sequence(start, F.col("pos") + n - 1)).alias("at")).distinct()
    return covered.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("at")).alias("removed"))


def dedup_lines(docs: DataFrame, n: int = LINES) -> DataFrame:
    """``docs`` with ``text`` cleaned and two more columns, n_lines and n_removed."""
    lost = repeated_lines(docs, n).select(F.struct(F.col("doc_id").alias("id"), "text_hash", "removed").alias(OWN))
    key = F.col(f"{OWN}.id").eqNullSafe(docs["doc_id"]) & (F.col(f"{OWN}.text_hash") == F.xxhash64(docs["text"]))
    joined = docs.join(lost, key, "left")
    lines = F.split(docs["text"], "\n", -1)
    # The lines between one removed position and the next, in one pass over both arrays.
    edges = F.concat(F.array(F.lit(-1)), F.col(f"{OWN}.removed"), F.array(F.size(lines)))
    gaps = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(
        lines, F.element_at(edges, i) + 2, F.element_at(edges, i + 1) - F.element_at(edges, i) - 1))
    cleaned = F.when(F.col(OWN).isNull(), docs["text"]).otherwise(F.array_join(F.flatten(gaps), "\n"))
    columns = [cleaned.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col(OWN).isNull(), 0).otherwise(F.size(F.col(f"{OWN}.removed"))).cast("long")
    return joined.select(*columns, n_lines.alias("n_lines"), n_removed.alias("n_removed"))

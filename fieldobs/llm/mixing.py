"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are ranged by that key
into buckets of about ``bucket_rows``; bucket totals are summed up by a window over the
buckets, and each bucket's own documents by a window inside it. Together they give the running
sum of tokens in key order without any task seeing a whole source, so a source with a third of
all documents is as many buckets as it needs. Each source is then cut at its exact budget:
whole epochs first, the rest from the start of the key order.

Sources are weighed in code-point order (null last) by a repeating list of weights. Targets
are bounded by ``max_epochs`` times the source; the excess goes to the others by weight, which
is the level at which all bounded targets together reach the wanted total.

Defined cases: a null text has size 0; a document of size 0 is taken in as many words, none;
repeated rows are documents of their own; an empty table gives no rows; other columns are
ignored. Keys depend on the id alone; ties go by size and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldobs.llm.common import WORD, scratch, staged, word_count

WEIGHTS = (5, 2, 1)


def hash_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row a source goes through one task."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("n", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(listed, (F.col("n") % len(weights) + 1).cast("int")))
    s = s.withColumn("bound", (F.col("source_size") * max_epochs).cast("double"))
    s = s.withColumn("level", F.col("bound") / F.col("weight"))
    # Rising levels: all before a source are held at their bound if it is.
    rising = W.orderBy("level", "n").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.withColumn("held", F.coalesce(F.sum("bound").over(rising), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    s = s.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("reach", (F.col("wanted") - F.col("held")) / F.col("open_weight"))
    s = s.withColumn("free_level", F.min(F.when(F.col("level") > F.col("reach"), F.struct("level", "n", "reach"))).over(everything))
    fill = F.col("free_level.reach") * F.col("weight")
    return s.select("source", "source_size", F.when(F.col("level") <= F.col("reach"), F.col("bound")).otherwise(
        F.least("bound", fill)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: str = "mix-",
        bucket_rows: int = 8192, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document of ``docs`` (doc_id, text, source) what the mix takes of it.

    Returns doc_id, source, size, source_size, target, taken (words, repeats counted), epochs
    (whole copies), cut (words of one more, partial copy), and the columns named in ``keep``.

    Totals are taken from the sizes alone and staged, so Spark knows how small they are before it
    plans the rows, which are shuffled once, by bucket.
    """
    rows = docs.select(F.struct("doc_id", "source", *keep).alias("row"), F.col("source").alias("source"),
                       word_count("text").alias("size"), hash_key(F.col("doc_id"), seed).alias("key"),
                       F.xxhash64("text").alias("tie"))
    # A key's first eight hex digits place it in [0, 1): ranges of keys are buckets.
    rows = rows.withColumn("place", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))

    def placed(df: DataFrame, sources: DataFrame) -> DataFrame:
        ranged = F.floor(F.col("place") * F.col("buckets") / F.lit(2 ** 32)).cast("long")
        return df.join(sources, df["source"].eqNullSafe(sources["of"])).withColumn("bucket", ranged)

    with scratch(docs.sparkSession) as keep_staged:
        sizes = staged(rows.select("source", "size", "place"), "mix-sizes")
        totals = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), "mix-totals")
        wanted = targets(totals.select("source", "source_size"), weights, share, max_epochs).withColumnRenamed("source", "of")
        counts = totals.select(F.col("source").alias("in_source"), F.ceil(F.col("documents") / bucket_rows).cast("long").alias("buckets"))
        sources = keep_staged(wanted.join(counts, F.col("of").eqNullSafe(F.col("in_source"))).drop("in_source"), "mix-sources")
        sums = placed(sizes, sources).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
        before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        starts = keep_staged(sums.select(F.col("source").alias("in_source"), F.col("bucket").alias("in_bucket"),
                                         F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start")), "mix-starts")
    placed_rows = placed(rows, sources)
    inside = W.partitionBy("source", "bucket").orderBy("key", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    summed = placed_rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    summed = summed.join(starts, summed["source"].eqNullSafe(starts["in_source"]) & (summed["bucket"] == starts["in_bucket"]))

    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.least(F.greatest(rest - F.col("bucket_start") - F.col("inside"), F.lit(0)), F.col("size"))
    whole = F.when(cut == F.col("size"), 1).otherwise(0)
    return summed.select(
        "row.*", "size", "source_size", "target", (epochs * F.col("size") + cut).alias("taken"),
        F.when(F.col("size") > 0, epochs + whole).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("size") > 0, F.when(whole == 1, 0).otherwise(cut)).otherwise(0).cast("long").alias("cut"))


def copies(mixed: DataFrame) -> DataFrame:
    """The rows of a mix (with ``text`` kept) as often as it takes them; the copy at the budget is cut after its words."""
    taken = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))).where(
        (F.col("copy") < F.col("epochs")) | (F.col("cut") > 0))
    parts = F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"))
    cut = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.col("cut"), F.lit(1)).cast("int")), "")
    return taken.withColumn("text", F.when(F.col("copy") < F.col("epochs"), F.col("text")).otherwise(cut)).drop("copy")

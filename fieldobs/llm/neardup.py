"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct word shingles, hashed to 64 bits; its sketch is the ``k``
smallest hashes. Documents with equal sets are one class from the start. Classes are linked
when 100 * intersection >= ``percent`` * union, which is always confirmed on the full sets.

Candidates come from inverted lists of retained values. Linked sets share a minimum of their
retained values (all but five standard deviations of the sampling noise; no noise where the
sketch holds the whole set), so under any common order of values each pair meets in the lists
of the first few. The order is rarest first: passages that many documents share come last and
rarely reach a list. Values are counted with partial sums, and hot ones are split in the joins.

- Lists of at most ``short`` classes give their pairs. The estimate from the union's sketch
  drops those that are clearly apart; the full sets decide on the rest.
- Longer lists hold groups of many near copies, where pairs would grow with the square. Their
  classes go on with full sets, exact list lengths and a positional bound (what stands before
  the shared value on either side can't be shared), and first meet only the list's hub, the
  class with the fewest rarer values, which in a group of copies is nearest to the original.
  What then is still apart from the list's main component is compared across components. So
  every pair that could join two components is looked at, and pairs inside one are not.

Defined cases: a text with fewer words than a shingle is one shingle; a text without words, or
null, has an empty set and is linked with nothing; rows that repeat an id and text are in one
class; an empty table gives no rows; other columns are ignored. Sets are told apart by a 64-bit
hash. Only A-Z are lower-cased.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.llm.common import blocks_for, lean, map_texts, scratch, staged, text_bytes
from fieldobs.llm.components import components, joined

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Columns that tell rows apart: id, whether it is null, text.
_ROW = ["__neardup_id", "__neardup_no_id", "__neardup_h1", "__neardup_h2"]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; hashes of words are remembered."""

    def __init__(self, words: int, remember: int = 300_000):
        self.words, self.remember = words, remember
        self.hashes: dict[bytes, int] = {}

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
        return h ^ (h >> np.uint64(31))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.hashes) > self.remember:
            self.hashes.clear()
        split = [t.lower().split() for t in texts]
        for word in set().union(*split).difference(self.hashes):
            self.hashes[word] = xxhash.xxh3_64_intdigest(word)
        out = []
        for words in split:
            h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
            n = min(self.words, len(h))
            if n:
                mixed = np.zeros(len(h) - n + 1, np.uint64)
                for step in range(n):  # order matters: each word is mixed into what came before
                    mixed = self._mix(mixed * _MULTIPLIER + h[step:len(h) - n + 1 + step] + np.uint64(step + 1))
                if n < self.words:
                    mixed = self._mix(mixed + np.uint64(n))
                h = np.unique(mixed)
            out.append(h.view(np.int64) if n else np.empty(0, np.int64))
        return out


def _text_hash() -> tuple[Column, Column]:
    """128 bits that stand for a text; a null text has its own."""
    return F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")


def _key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, text_hash, n, cid, sketch): set size, class key and the k smallest hashes, sorted unsigned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingler.sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "cid", "sketch"])

    read = docs.select(F.col("doc_id").cast("long"), F.struct(*_text_hash()).alias("text_hash"), text_bytes().alias("text"))
    return map_texts(read, run, "doc_id long, text_hash struct<h1: long, h2: long>, n long, cid long, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, small: int = 200_000) -> DataFrame:
    """(cid, n, set) of the wanted classes (cid, doc_id), shingled anew from their documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            sets = shingler.sets(batch["text"].tolist())
            own = [(c, len(s), s) for c, s in zip(batch["cid"], sets) if len(s) and _key(s) == c]
            yield pd.DataFrame(own, columns=["cid", "n", "set"])

    wanted = wanted.select("cid", F.col("doc_id").alias("of"))
    if wanted.count() <= small:  # ids of at most some megabytes; beyond that the join shuffles
        wanted = F.broadcast(wanted)
    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("of")))
    return read.select("cid", "text").mapInPandas(lean(run), "cid long, n long, set array<long>").dropDuplicates(["cid"])


class Similarity:
    """The bounds that follow from the similarity, as integers and columns."""

    def __init__(self, percent: int, k: int):
        t = percent / 100
        self.percent, self.k = percent, k
        self.floor = max(t - 5 * math.sqrt(t * (1 - t) / k), 0.0)
        self.shared = max(1, math.floor(self.floor * k))

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def sketch_prefix(self, n: Column, kept: Column) -> Column:
        """How many of the first retained values must hold one that a linked set shares."""
        exact = n * 100 <= self.percent * self.k  # then every linked set's sketch is whole, too
        need = F.when(exact, F.ceil(n * self.percent / 100)).otherwise(F.least(kept, F.lit(self.shared)))
        return kept - need + 1

    def full_prefix(self, n: int) -> int:
        return n - -(-n * self.percent // 100) + 1

    def positions_fit(self, n: Column, i: Column, m: Column, j: Column) -> Column:
        """At most what stands from the shared value on is common: I >= percent / (100 + percent) * (n + m)."""
        return F.least(n - i, m - j) * (100 + self.percent) >= (n + m) * self.percent

    def linked(self, common: Column, n: Column, m: Column) -> Column:
        return common * 100 >= (n + m - common) * self.percent


def _prefixes(reps: DataFrame, similarity: Similarity) -> DataFrame:
    """(value, cid, n) of the rarest retained values of each class, of which others hold some."""
    postings = reps.select("cid", F.explode("sketch").alias("value"))
    counts = postings.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1")
    hits = postings.join(counts, "value").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("hits"))
    sized = hits.join(reps.select("cid", "n", F.size("sketch").alias("kept")), "cid")
    # Values of the class alone come first and fill a part of the prefix.
    left = similarity.sketch_prefix(F.col("n"), F.col("kept")) - (F.col("kept") - F.size("hits"))
    cut = sized.withColumn("left", left).where("left > 0")
    return cut.select("cid", "n", F.explode(F.slice("hits", F.lit(1), F.col("left").cast("int"))).alias("hit")).select(
        F.col("hit.value").alias("value"), "cid", "n")


def _full_prefixes(sets: DataFrame, similarity: Similarity, block_sets: int = 500) -> DataFrame:
    """(value, cid, n, pos) of the rarest values of each full set, of which others hold some.

    Sets are dealt into blocks; a block asks once for each of its distinct values, however many
    of its sets hold it, so that a group of copies costs about its edits and not its size times
    its length.
    """
    blocks = blocks_for(sets.count(), block_sets)
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)))

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values, n = np.unique(np.concatenate(rows["set"].to_numpy()), return_counts=True)
        return pd.DataFrame({"block": key[0], "value": values, "held": n})

    def rank(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("value")
        known, freq = told["value"].to_numpy(np.int64), told["freq"].to_numpy(np.int64)
        out = []
        for cid, n, own in zip(rows["cid"], rows["n"], rows["set"]):
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            often = np.where(known[at] == own, freq[at], 1) if len(known) else np.ones(len(own), np.int64)
            order = np.lexsort((own, often))[:similarity.full_prefix(n)]
            pos = np.flatnonzero(often[order] > 1)
            out.append(pd.DataFrame({"value": own[order[pos]], "cid": cid, "n": n, "pos": pos}))
        return pd.concat(out) if out else pd.DataFrame({"value": [], "cid": [], "n": [], "pos": []})

    asked = staged(dealt.groupBy("block").applyInPandas(ask, "block long, value long, held long"), "near-values")
    counts = asked.groupBy("value").agg(F.sum("held").alias("freq")).where("freq > 1")
    told = asked.select("block", "value").join(counts, "value")
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(rank, "value long, cid long, n long, pos long")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Of pairs (a, b), those whose full sets are linked."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(similarity.linked(common, F.col("n_a"), F.col("n_b"))).select("a", "b")


def _pairs(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.alias("x").join(right.alias("y"), (F.col("x.value") == F.col("y.value")) & on).select(
        F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def linked_classes(docs: DataFrame, reps: DataFrame, words: int, similarity: Similarity, short: int) -> DataFrame:
    """(node, component) of every class that is linked with another."""
    prefixes = staged(_prefixes(reps, similarity), "near-lists")
    lengths = prefixes.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    listed = staged(prefixes.join(lengths, "value"), "near-lists")
    fit = similarity.sizes_fit(F.col("x.n"), F.col("y.n"))

    few = listed.where(F.col("length") <= short)
    close = _pairs(few, few, (F.col("x.cid") < F.col("y.cid")) & fit)
    one, two = (reps.select(F.col("cid").alias(c), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b"), _unsigned), 1, similarity.k)
    both = close.join(one, "a").join(two, "b").withColumn("union", union)
    shared = F.size(F.array_intersect(F.array_intersect("union", "s_a"), F.col("s_b")))
    near = staged(both.where(shared >= F.size("union") * similarity.floor).select("a", "b"), "near-pairs")

    dense = listed.where(F.col("length") > short).select("cid").distinct()
    wanted = near.select(F.explode(F.array("a", "b")).alias("cid")).union(dense).distinct()
    sets = staged(full_sets(docs, wanted.join(reps.select("cid", "doc_id"), "cid"), words), "near-sets")
    found = staged(_confirmed(near, sets, similarity), "near-links")

    # Full sets of the classes in long lists, by their values, rarest among these classes first.
    long_lists = staged(_full_prefixes(staged(sets.join(dense, "cid"), "near-dense"), similarity), "near-dense")
    fit &= similarity.positions_fit(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    hubs = long_lists.groupBy("value").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "cid", "n", "pos")).alias("hub"))
    hubs = hubs.select("value", "hub.cid", "hub.n", "hub.pos")
    at_hub = staged(_pairs(hubs, long_lists, (F.col("x.cid") != F.col("y.cid")) & fit), "near-pairs")
    found = staged(found.union(_confirmed(at_hub, sets, similarity)).distinct(), "near-links")

    # What a list's main component lacks, against all other components of the list.
    placed = staged(components(found), "near-components")
    grouped = long_lists.join(placed.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    grouped = staged(grouped, "near-dense")
    weighed = grouped.groupBy("value", "component").agg(F.count("*").alias("size"))
    main = weighed.groupBy("value").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
    split = main.where("parts > 1").select("value", F.col("main.component").alias("main"))
    open_lists = grouped.join(split, "value")
    apart = F.col("x.component") != F.col("y.component")
    across = _pairs(open_lists.where("component != main"), open_lists, apart & fit).join(at_hub, ["a", "b"], "left_anti")
    return joined(placed, staged(_confirmed(across, sets, similarity), "near-links"))


def _unsigned(x: Column, y: Column) -> Column:
    """Hashes are ordered as unsigned numbers, kept in signed columns."""
    u, v = x.bitwiseXOR(F.lit(-(1 << 63))), y.bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(u < v, -1).when(u > v, 1).otherwise(0)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 64, short: int = 32) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    A component is what links of at least ``percent`` similarity connect; its smallest id
    names it, and that document is the one that is kept. A last column, text_hash, tells rows
    of one id apart.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, words, Similarity(percent, k), k, short), "near-duplicates")


def _components(docs: DataFrame, words: int, similarity: Similarity, k: int, short: int) -> DataFrame:
    """What ``near_duplicates`` returns, over frames that are staged on the way."""
    sets = staged(sketches(docs, words, k), "near-sketches")
    reps = staged(sets.where("n > 0").groupBy("cid").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-classes")
    # Components by class key, then named by their smallest document.
    placed = linked_classes(docs, reps, words, similarity, short).withColumnRenamed("node", "cid")
    named = reps.select("cid", "doc_id").join(placed, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.select(F.col("cid").alias("of"), "component").join(names, "component").select("of", "component_id")
    told = sets.select("doc_id", "text_hash", "n", "cid").join(of, F.col("cid") == F.col("of"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept; of rows that repeat an id and text, one.

    Repeats meet by the keys of the join, which are never null, so the texts are shuffled once.
    """
    def keyed(df: DataFrame, *text_hash: Column) -> DataFrame:
        doc_id = F.col("doc_id").cast("long")
        return df.withColumns(dict(zip(_ROW, (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), *text_hash))))

    kept = near_duplicates(docs, words, percent).where("kept")
    kept = keyed(kept, F.col("text_hash.h1"), F.col("text_hash.h2")).select(*_ROW).distinct()
    return keyed(docs, *_text_hash()).dropDuplicates(_ROW).join(kept, _ROW, "left_semi").select(*docs.columns)

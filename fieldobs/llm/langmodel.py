"""Languages told by models learned from every labelled document, with all counts in Spark.

The measure is that of ``langid``: a text's code length under a tree of byte contexts per language.
Here no document is left out of a tree or of a limit, and no tree is held whole by anyone, as
its size grows with the corpus:

- Documents lie in blocks of some 10 MB. Each block tells how often every byte in its context (a
  code) occurs under each label; Spark sums these counts over the blocks.
- Codes whose contexts end in the same two bytes go to one shard, which holds the deeper levels of
  all trees for them. The two lowest levels, 2**16 counts a language at most, go to all shards.
- A shard gives the bits that each code of the corpus takes under every tree; a block gets those of
  its own codes, and adds them up by word and text.

Two folds of the documents learn from each other: a text is measured by the trees of the other
fold; only a language that its own fold alone has is taken from there. Bits are counted in
``UNIT``-ths, so sums are exact and reruns agree.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.llm import ppm
from fieldobs.llm.common import blocks_for, map_texts, scratch, staged
from fieldobs.llm.langid import BELIEVED, FAMILIAR, FAR, FAR_TAIL, LEAST_KEPT, UNKNOWN

UNIT = 1 << 16
#: Bits per byte are held against limits in steps of this part of a bit.
STEP = 1000
BLOCK_BYTES = 10 << 20
SHARD_CODES = 100_000


def _words(texts: pa.ChunkedArray | pa.Array) -> list[list[bytes]]:
    return [(t or b"").lower().split() for t in texts.cast(pa.binary()).to_pylist()]


def _blocks(docs: DataFrame, fold: Column) -> DataFrame:
    """The rows with a block, whose lowest bit is the fold; rows of a block follow one another."""
    rows = staged(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("fold", fold.cast("long")), "blocks")
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    each = max(1, 2 * BLOCK_BYTES * n // max(size or 0, 1))
    return rows.withColumn("block", F.floor(F.col("row") / F.lit(min(each, 1 << 20))).cast("long") * 2 + F.col("fold"))


def _counts(blocks: DataFrame, order: int) -> DataFrame:
    """(block, lang, code, n, first): codes by block and label; one row of each code in a block is its first."""
    def told(held: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for (block, lang), words in held.items():
            if not words:
                continue
            codes, starts = ppm.word_codes(list(words), order)
            n = np.repeat(list(words.values()), np.diff(np.append(starts, len(codes))))
            distinct, inverse = np.unique(codes, return_inverse=True)
            before = seen.get(block, np.empty(0, np.int64))
            first = ~np.isin(distinct, before, assume_unique=True)
            seen[block] = np.concatenate([before, distinct[first]])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(distinct), block)), pa.array([lang] * len(distinct), pa.string()), pa.array(distinct),
                pa.array(np.bincount(inverse, n, len(distinct)).astype(np.int64)), pa.array(first)],
                ["block", "lang", "code", "n", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = defaultdict(Counter)
        at, size = None, 0
        for batch in batches:
            keys = zip(batch.column("block").to_pylist(), batch.column("lang").to_pylist())
            for (block, lang), words in zip(keys, _words(batch.column("text"))):
                if block >> 1 != at or size > 4 * BLOCK_BYTES:
                    yield from told(held)
                    held.clear()
                    at, size = block >> 1, 0
                held[block, lang].update(words)
                size += sum(map(len, words))
        yield from told(held)

    return staged(map_texts(blocks.select("block", F.col("lang").cast("string").alias("lang"), "text"), run,
                            "block long, lang string, code long, n long, first boolean"), "codes")


def _code_bits(counts: DataFrame, order: int) -> tuple[list[str], DataFrame]:
    """The languages, and (fold, code, bits): what each code takes under their trees for a text of the fold."""
    spark, fold = counts.sparkSession, F.col("block").bitwiseAND(F.lit(1).cast("long")).alias("fold")
    grams = staged(counts.where(F.col("lang").isNotNull()).groupBy(fold, "lang", "code").agg(F.sum("n").alias("n")), "grams")
    wanted = staged(counts.where("first").select(fold, "code").distinct(), "wanted")
    pairs: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    for row in grams.groupBy("fold", "lang", F.expr("code & 65535L").alias("low")).agg(F.sum("n").alias("n")).collect():
        for values, value in zip(pairs[row.fold, row.lang], (row.low, row.n)):
            values.append(value)
    low = {key: (np.array(c, np.int64), np.array(n, float)) for key, (c, n) in pairs.items()}
    langs = sorted({lang for _, lang in low})
    sent = spark.sparkContext.broadcast(low)

    def cost(known: pa.Table, asked: pa.Table) -> pa.Table:
        trees = {}
        fold, lang, code, n = (known.column(c).to_numpy() for c in ("fold", "lang", "code", "n"))

        def tree(key: tuple) -> ppm.Trie:
            if key not in trees:
                own = (fold == key[0]) & (lang == key[1])
                trees[key] = ppm.Trie(code[own], n[own].astype(float), order, sent.value[key])
            return trees[key]

        parts = []
        for own in (0, 1):
            codes = asked.column("code").to_numpy()[asked.column("fold").to_numpy() == own]
            by = [(1 - own if (1 - own, name) in sent.value else own, name) for name in langs]
            bits = np.stack([tree(key).cost(codes) for key in by], 1)
            units = pa.array(np.rint(bits * UNIT).astype(np.int64).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(langs)), units)
            parts.append(pa.table([pa.array(np.full(len(codes), own)), pa.array(codes), listed], ["fold", "code", "bits"]))
        return pa.concat_tables(parts)

    if not langs:
        return langs, wanted
    shards = blocks_for(grams.count() + wanted.count(), SHARD_CODES)
    shard = F.pmod(F.xxhash64(F.expr("shiftright(code, 8) & 65535L")), F.lit(shards)).alias("shard")
    return langs, grams.groupBy(shard).cogroup(wanted.groupBy(shard)).applyInArrow(
        cost, "fold long, code long, bits array<long>")


def measure(docs: DataFrame, fold: Column, order: int = 4) -> tuple[list[str], DataFrame]:
    """The languages learned, and every row of ``docs`` (text, lang, ...) with its fold, size and bits.

    ``fold`` is 0 or 1. ``bits`` has the length of the text under each language's tree in ``UNIT``-ths of
    a bit; ``size`` is the number of bytes coded. Without any label there are no languages, and the
    rows come as they are.
    """
    with scratch(docs.sparkSession) as keep:
        langs, measured = _measured(docs, fold, order)
        return langs, keep(measured, "measured") if langs else docs


def _measured(docs: DataFrame, fold: Column, order: int) -> tuple[list[str], DataFrame]:
    """What ``measure`` returns, over frames that are staged on the way."""
    columns = docs.columns
    blocks = _blocks(docs, fold)
    counts = _counts(blocks, order)
    langs, code_bits = _code_bits(counts, order)
    if not langs:
        return langs, docs
    own = counts.where("first").select("block", "code", F.col("block").bitwiseAND(F.lit(1).cast("long")).alias("fold"))
    told = own.join(code_bits, ["fold", "code"]).select("block", "code", "bits")

    def add_up(texts: pa.Table, costs: pa.Table) -> pa.Table:
        codes = costs.column("code").to_numpy()
        at = np.argsort(codes)
        codes, bits = codes[at], costs.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, len(langs))[at]
        sums, sizes = np.zeros((texts.num_rows, len(langs)), np.int64), np.zeros(texts.num_rows, np.int64)
        index: dict[bytes, int] = {}
        by_word = np.empty((0, len(langs)), np.int64)
        for start in range(0, texts.num_rows, 250):
            lists = _words(texts.column("text").slice(start, 250))
            fresh = list(set().union(*lists).difference(index))
            if fresh:
                of, starts = ppm.word_codes(fresh, order)
                by_word = np.concatenate([by_word, np.add.reduceat(bits[np.searchsorted(codes, of)], starts)])
                index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            lengths = np.array([len(t) for t in lists])
            full = np.flatnonzero(lengths)
            if len(full):
                ids = np.fromiter((i for t in lists for i in map(index.__getitem__, t)), np.int64, lengths.sum())
                sums[start + full] = np.add.reduceat(by_word[ids], np.cumsum(lengths[full]) - lengths[full])
            sizes[start:start + len(lists)] = [sum(map(len, t)) + len(t) for t in lists]
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * len(langs)), pa.array(sums.ravel()))
        kept = texts.select([*columns, "fold"])
        return kept.append_column("size", pa.array(sizes)).append_column("bits", listed)

    schema = docs.withColumns({"fold": F.lit(0).cast("long"), "size": F.lit(0).cast("long"),
                               "bits": F.lit(None).cast("array<long>")}).schema
    return langs, blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(add_up, schema)


def _quantile(counts: dict[int, int], q: float) -> float:
    """The quantile of values given with their numbers, between two values by their distance."""
    values = np.array(sorted(counts))
    upto = np.cumsum([counts[v] for v in values.tolist()])
    place = q * (upto[-1] - 1)
    below, above = (values[np.searchsorted(upto, f(place), "right")] for f in (np.floor, np.ceil))
    return float(below + (above - below) * (place - np.floor(place))) / STEP


def limits(langs: list[str], measured: DataFrame) -> dict[tuple[int, str], tuple[float, float]]:
    """(median, limit) of the bits per byte by fold and language, from all labelled rows with a letter.

    A row counts under its own label's tree, which the other fold learned. The limit is ``FAR`` times
    the median or ``FAR_TAIL`` times the 95 % quantile: labels that are wrong for one document in
    twenty don't move it. A language with fewer than ``LEAST_KEPT`` rows in a fold goes by all
    languages together; with fewer in all, nothing is too far.
    """
    spark = measured.sparkSession
    place = F.array_position(F.lit(langs), F.col("lang")).cast("int")
    own = measured.where(F.col("lang").isNotNull() & (F.col("size") > 0) & F.regexp_like("text", F.lit(r"\p{L}"))).select(
        "fold", "lang", "size", (F.element_at("bits", place) / float(UNIT)).alias("own"))

    def numbers(rows: DataFrame, value: Column, by: tuple[str, ...]) -> dict[tuple, dict[int, int]]:
        out: dict[tuple, dict[int, int]] = defaultdict(dict)
        for r in rows.groupBy(*by, F.round(value * STEP).cast("long").alias("value")).count().collect():
            out[tuple(r[c] for c in by)][r["value"]] = r["count"]
        return out

    near = numbers(own, F.col("own") / F.col("size"), ("fold", "lang"))
    every: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for (fold, _), counts in near.items():
        every[fold].update(counts)
    enough = {fold: sum(counts.values()) >= LEAST_KEPT for fold, counts in every.items()}
    overall = {fold: _quantile(every[fold], 0.5) if enough[fold] else 0.0 for fold in every}
    median = {key: _quantile(counts, 0.5) if sum(counts.values()) >= LEAST_KEPT else None for key, counts in near.items()}
    if not median:
        return {(fold, lang): (0.0, np.inf) for fold in every for lang in langs}
    known = F.broadcast(spark.createDataFrame([(*key, m, overall[key[0]]) for key, m in median.items()],
                                              "fold long, lang string, own_median double, all_median double"))
    rows = own.join(known, ["fold", "lang"])

    def smoothed(middle: str) -> Column:
        return (F.col("own") + FAMILIAR * F.col(middle)) / (F.col("size") + FAMILIAR)

    tails = numbers(rows.where(F.col("own_median").isNotNull()), smoothed("own_median"), ("fold", "lang"))
    all_tails = numbers(rows, smoothed("all_median"), ("fold",))
    found = {}
    for fold in every:
        for lang in langs:
            middle, tail = median.get((fold, lang)), tails.get((fold, lang))
            if middle is None:
                middle, tail = overall[fold], all_tails.get((fold,)) if enough[fold] else None
            found[fold, lang] = (middle, max(FAR * middle, FAR_TAIL * _quantile(tail, 0.95)) if tail else np.inf)
    return found


def tell(langs: list[str], measured: DataFrame, limits: dict[tuple[int, str], tuple[float, float]],
         sharpness: float = 8.0) -> DataFrame:
    """The measured rows with ``lang_pred`` and ``score``, as ``langid.identify`` gives them.

    A text beyond every language's limit, or without a letter, is ``und`` with score 0. The language
    a row is labelled with stays unless its tree does clearly worse (``BELIEVED``).
    """
    def of_fold(n: int) -> Column:
        zero, one = (F.array(*[F.lit(float(limits[fold, lang][n])) for lang in langs]) for fold in (0, 1))
        return F.when(F.col("fold") == 0, zero).otherwise(one)

    names, size = F.lit(langs), F.col("size")
    best = F.array_min(F.transform("bits", lambda b, j: F.struct(
        (b * F.when(F.get(names, j) == F.coalesce("lang", F.lit("")), BELIEVED).otherwise(1.0)).alias("cost"), j.alias("at"))))["at"]
    near = F.exists(F.transform("bits", lambda b, j: (b / float(UNIT) + FAMILIAR * F.get("median", j)) / (size + FAMILIAR)
                                <= F.get("limit", j)), lambda x: x)
    per_byte = F.transform("bits", lambda b: (b - F.array_min("bits")) / float(UNIT) / F.greatest(size, F.lit(1)))
    weight = F.aggregate(per_byte, F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), -sharpness * x))
    lettered = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    known = measured.withColumns({"median": of_fold(0), "limit": of_fold(1)}).withColumn("near", lettered & near)
    return known.withColumns({
        "lang_pred": F.when(F.col("near"), F.get(names, best)).otherwise(UNKNOWN),
        "score": F.when(F.col("near"), 1 / weight).otherwise(0.0)}).drop("median", "limit", "near", "fold", "size", "bits")

"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes within a word, counted over
labelled documents and then frozen. A text's code length under every tree is the exact sum over
its bytes, with escapes to shorter contexts (``ppm``); the shortest wins. Since contexts stay
within words, a task codes each distinct word once per language and adds up the words of its texts.

The trees are fitted on a bounded sample: of every language at most ``sample_docs`` training
documents, those with the smallest hash of the id, whole and of any length, until they have
``sample_docs * sample_bytes`` bytes. So their size has a bound that the corpus doesn't move, and
they may be sent to every task. Scoring
reads every document and whole texts.

``limits`` says how far a text may be from every language: of each it has the bits per byte that
labelled documents kept out of the fit need. ``identify`` calls a text ``und`` that needs far more
under every tree, so gibberish and languages never learned are told from the learned ones.

Defined cases: a text that is null, empty or has no letter is ``und`` with score 0, as is every
text when nothing could be learned; ties go to the language first in order; repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldobs.llm import ppm
from fieldobs.llm.common import map_texts, staged, text_bytes

UNKNOWN = "und"
#: So many documents of each label are drawn whatever their length.
FIRST = 10
#: A text is too far when it needs this many times the bits per byte of a language's median document,
FAR = 3.0
#: or this many times those of the document at the 95 % quantile, if that is more.
FAR_TAIL = 1.25
#: Typical bytes added to a text when its bits per byte are held against a limit: a short text says little.
FAMILIAR = 32
#: A label is believed unless another language needs less than this share of its bits.
BELIEVED = 0.6
#: A language with fewer documents kept out goes by the documents of all languages together.
LEAST_KEPT = 10


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, longest: int | None = None, seed: int = 11,
           mean_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` documents of each label, by the smallest hash of the id.

    ``docs`` has doc_id and text, ``labels`` (doc_id, label). With ``mean_bytes``, a label's documents
    end with the one that takes them to ``limit * mean_bytes`` bytes, but not before the first
    ``FIRST``; each is whole. Texts of any length are drawn unless ``longest`` says otherwise.
    Only ids are joined, cut and ranked: a threshold on the hash first cuts each label to
    about twice the limit, so that ranking never sees a whole label. The ids drawn, whose number
    is bounded, then go to the texts.
    """
    docs = docs.select("doc_id", "text")  # no other column can clash with the ones added here
    size = F.octet_length("text")
    read = docs.where(size.isNotNull() if longest is None else size <= longest).select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), size.cast("long").alias("size"))
    known = labels.where(F.col(label).isNotNull()).select("doc_id", label).distinct()
    fit = read.join(known, F.col("id") == F.col("doc_id")).select(
        "id", "hash", "size", label, (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)).alias("draw"))
    totals = fit.groupBy(F.col(label).alias("of")).agg(F.count("*").alias("total"))
    if totals.count() <= 10_000:  # so that no label's rows have to meet in one task
        totals = F.broadcast(totals)
    near = fit.join(totals, fit[label] == totals["of"]).where(F.col("draw") * F.col("total") <= 2.0 * limit)
    first = W.partitionBy(label).orderBy("draw", "id", "hash")
    ranked = near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)
    if mean_bytes is not None:
        before = F.coalesce(F.sum("size").over(first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.withColumn("before", before).where((F.col("nth") <= FIRST) | (F.col("before") < limit * mean_bytes))
    drawn = staged(ranked.select("id", "hash", label), "sample")
    if drawn.count() <= 100_000:
        drawn = F.broadcast(drawn)
    return docs.join(drawn, (docs["doc_id"] == F.col("id")) & (F.xxhash64(docs["text"]) == F.col("hash"))).select(
        F.col("id").alias("doc_id"), docs["text"], label)


def fit(docs: DataFrame, train: Column, order: int = 4, sample_docs: int = 1500,
        sample_bytes: int = 1 << 16) -> dict[str, ppm.Trie]:
    """One frozen tree per language, from the labelled rows of ``docs`` (doc_id, text, lang) that ``train`` names."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                words = Counter(w for text in part["text"] for w in text.lower().split())
                codes, starts = ppm.word_codes(list(words), order)
                n = np.repeat(list(words.values()), np.diff(np.append(starts, len(codes))))
                distinct, inverse = np.unique(codes, return_inverse=True)
                yield pd.DataFrame({"lang": lang, "code": distinct, "n": np.bincount(inverse, n, len(distinct)).astype(np.int64)})

    train_docs = docs.where(train).select("doc_id", "text", "lang")
    rows = sample(train_docs.select("doc_id", "text"), train_docs.select("doc_id", "lang"), "lang", sample_docs, mean_bytes=sample_bytes)
    grams = rows.select("lang", text_bytes().alias("text")).mapInPandas(count, "lang string, code long, n long").groupBy(
        "lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return {lang: ppm.Trie(g["code"].to_numpy(np.int64), g["n"].to_numpy(float), order)
            for lang, g in sorted(grams.groupby("lang"), key=lambda x: x[0])}


class WordCosts:
    """Bits of each word under every tree; words and codes already met are remembered."""

    def __init__(self, tries: list[ppm.Trie], remember: int = 2_000_000):
        self.tries, self.order = tries, tries[0].order
        self.remember = max(10_000, remember // (4 + len(tries)))
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bits = np.empty((0, len(self.tries)), np.float32)
        self.codes, self.code_bits = np.empty(0, np.int64), np.empty((0, len(self.tries)), np.float32)

    def learn(self, words: list[bytes]) -> None:
        codes, starts = ppm.word_codes(words, self.order)
        distinct, inverse = np.unique(codes, return_inverse=True)
        new = np.setdiff1d(distinct, self.codes, assume_unique=True)
        bits = np.stack([t.cost(new) for t in self.tries], 1).astype(np.float32)
        every = np.concatenate([self.codes, new])
        by_code = np.argsort(every, kind="stable")
        self.codes, self.code_bits = every[by_code], np.concatenate([self.code_bits, bits])[by_code]
        told = self.code_bits[np.searchsorted(self.codes, distinct)]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.bits = np.concatenate([self.bits, np.add.reduceat(told[inverse], starts)])

    def totals(self, texts: list[list[bytes]]) -> np.ndarray:
        """Bits of each text, a list of words, under every tree."""
        if len(self.index) > self.remember:
            self.forget()
        new = list(set().union(*texts).difference(self.index))
        if new:
            self.learn(new)
        lengths = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.tries)))
        full = np.flatnonzero(lengths)
        if len(full):
            ids = np.fromiter((i for t in texts for i in map(self.index.__getitem__, t)), np.int64, lengths.sum())
            starts = np.cumsum(lengths[full]) - lengths[full]
            out[full] = np.add.reduceat(self.bits[ids].astype(np.float64), starts)
        return out


def limits(docs: DataFrame, kept_out: Column, tries: dict[str, ppm.Trie], sample_docs: int = 500,
           sample_bytes: int = 1 << 16) -> dict[str, tuple[float, float]]:
    """(median, limit) of the bits per byte of each language, from the labelled rows that ``kept_out`` names.

    A document counts under its own label's tree. The limit is ``FAR`` times the median or
    ``FAR_TAIL`` times the 95 % quantile: labels that are wrong for one document in twenty don't
    move it. With fewer than ``LEAST_KEPT`` documents in all, nothing is too far.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tries)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, costs = list(sent.value), WordCosts(list(sent.value.values()))
        for batch in batches:
            texts = [t.lower().split() for t in batch["text"]]
            own = costs.totals(texts)[np.arange(len(texts)), [langs.index(lang) for lang in batch["lang"]]]
            n = np.array([sum(map(len, t)) + len(t) for t in texts])
            yield pd.DataFrame({"lang": batch["lang"], "bits": own, "n": n})[n > 0]

    rows = docs.where(kept_out & F.col("lang").isin(list(tries)) & F.regexp_like("text", F.lit(r"\p{L}")))
    drawn = sample(rows.select("doc_id", "text"), rows.select("doc_id", "lang"), "lang", sample_docs, mean_bytes=sample_bytes)
    told = drawn.select("lang", text_bytes().alias("text")).mapInPandas(measure, "lang string, bits double, n long").toArrow().to_pandas()

    def fitted(rows: pd.DataFrame) -> tuple[float, float]:
        median = (rows["bits"] / rows["n"]).median()
        tail = ((rows["bits"] + FAMILIAR * median) / (rows["n"] + FAMILIAR)).quantile(0.95)
        return float(median), float(max(FAR * median, FAR_TAIL * tail))

    every = fitted(told) if len(told) >= LEAST_KEPT else (0.0, np.inf)
    own = dict(list(told.groupby("lang")))
    return {lang: fitted(own[lang]) if len(own.get(lang, ())) >= LEAST_KEPT else every for lang in tries}


def identify(docs: DataFrame, tries: dict[str, ppm.Trie], sharpness: float = 8.0, keep: tuple[str, ...] = (),
             limits: dict[str, tuple[float, float]] | None = None, label: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text), and the columns named in ``keep``.

    The score weighs the languages' bits per byte as if the text were ``sharpness`` bytes long,
    so that it tells close calls from clear ones at any length. With ``limits`` given, a text
    beyond every language's limit is ``und`` with score 0. ``label`` names a column with the
    language a text is said to be in, which stays unless its tree does clearly worse (``BELIEVED``).
    """
    langs = list(tries)
    median, limit = np.array([(limits or {}).get(lang, (0.0, np.inf)) for lang in langs]).reshape(-1, 2).T
    sent = docs.sparkSession.sparkContext.broadcast(list(tries.values()))

    def trust(part: pa.RecordBatch) -> np.ndarray:
        said = np.array(part.column("said").to_pylist(), object)
        return np.where(said[:, None] == np.array(langs, object), BELIEVED, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = WordCosts(sent.value) if langs else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                preds, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if langs:
                    texts = [t.lower().split() for t in part.column("bytes").to_pylist()]
                    bits = costs.totals(texts)
                    n = np.array([sum(map(len, t)) + len(t) for t in texts])
                    per_byte = bits / np.maximum(n, 1)[:, None]
                    best = (bits * trust(part)).argmin(1)
                    near = ((bits + FAMILIAR * median) / (n + FAMILIAR)[:, None] <= limit).any(1)
                    weights = np.exp2(-sharpness * (per_byte - per_byte.min(1, keepdims=True)))
                    lettered = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & near
                    preds[lettered] = np.array(langs, object)[best[lettered]]
                    scores[lettered] = (1 / weights.sum(1))[lettered]
                told = [part.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(told + [part.column(name) for name in kept], ["doc_id", "lang_pred", "score", *kept])

    kept = [f"kept_{i}" for i in range(len(keep))]  # under names of their own on the way
    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("bytes"),
                       (F.col(label) if label else F.lit(None)).cast("string").alias("said"),
                       F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)).alias("lettered"),
                       *[F.col(c).alias(name) for c, name in zip(keep, kept)])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), *[read.schema[name] for name in kept]])
    told = map_texts(read, run, schema)
    return told.select("doc_id", "lang_pred", "score", *[F.col(name).alias(c) for c, name in zip(keep, kept)])

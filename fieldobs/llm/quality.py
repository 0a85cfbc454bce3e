"""Document quality by random indexing and a small network.

Every term has a fixed sparse index vector of +1 and -1, drawn from its hash; a term's word
vector is the sum of the index vectors of its neighbours over the sample, scaled to length
one. A document is the mean of its words' vectors. A word that the vocabulary lacks stands as
its shape (runs of letters and digits collapsed, marks kept), and a word that repeats the one
before it as one special term, so that no word is without a vector. A two-layer network turns
the mean into a probability, which a temperature fitted on unseen rows calibrates.

Everything is fitted on a bounded sample: at most ``sample_docs`` labelled training documents of
each label, by the smallest hash of the id, whole, until they have ``sample_docs * sample_bytes`` bytes; the vocabulary
holds at most ``vocabulary`` terms. Neighbour sums and document vectors are worked out on
Spark, the network (a few thousand rows) on the driver. Labels weigh as in all labelled rows,
not as in the sample. Scoring reads every document and whole texts.

Defined cases: a text without words has the zero vector and gets the network's answer to it; if
only one label is known, every score is that label's share; without labels it is 0.5; repeated
rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.llm.common import map_texts, staged, text_bytes
from fieldobs.llm.langid import sample

REPEAT = b" repeat"
UNKNOWN = b" unknown"
_RUNS = re.compile(rb"([A-Z])[A-Z]+|([a-z\x80-\xff])[a-z\x80-\xff]+|([0-9])[0-9]+")


def shape(word: bytes) -> bytes:
    """' Aa%%%' for 'Whou%%%': one letter for a run, a digit for a number, marks as they are. The whole word counts."""
    plain = re.sub(rb"[0-9]", b"9", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", word)))
    plain = _RUNS.sub(lambda m: m[0][:1], plain)
    return b" " + plain


def index_vector(term: bytes, dims: int, marks: int = 8) -> np.ndarray:
    """The term's fixed vector: half of ``marks`` places +1, the others -1."""
    draw = np.random.default_rng(zlib.crc32(term))
    out = np.zeros(dims, np.float32)
    out[draw.choice(dims, marks, replace=False)] = np.repeat([1.0, -1.0], marks // 2)
    return out


class Terms:
    """Texts to numbers of vocabulary terms; words already met are remembered."""

    def __init__(self, vocabulary: list[bytes], remember: int = 300_000):
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.terms = np.empty(0, np.int32)

    def term(self, word: bytes) -> int:
        found = self.number.get(word)
        if found is None:
            found = self.number.get(shape(word), self.number[UNKNOWN])
        return found

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' term numbers in a row, and each text's length."""
        if len(self.seen) > self.remember:
            self.forget()
        words = [t.split() for t in texts]
        new = list(set().union(*words).difference(self.seen))
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
        self.terms = np.concatenate([self.terms, np.array([self.term(w) for w in new], np.int32)])
        lengths = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter((i for w in words for i in map(self.seen.__getitem__, w)), np.int64, lengths.sum())
        terms = self.terms[ids]
        again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
        starts = np.cumsum(lengths) - lengths
        terms[np.setdiff1d(again, starts)] = self.number[REPEAT]
        return terms, lengths


def pooled(vectors: np.ndarray, terms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean vector of each text."""
    out = np.zeros((len(lengths), vectors.shape[1]), np.float32)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(vectors[terms], starts) / lengths[full, None]
    return out


class Network:
    """One hidden layer of tanh units, one logistic output; trained with Adam on weighted rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, rounds: int = 600,
                 rate: float = 0.02, decay: float = 1e-4):
        draw = np.random.default_rng(7)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.layers = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                       draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
        self.temperature = 1.0
        z, weight = (x - self.mean) / self.scale, weight / weight.sum()
        first, second = [np.zeros_like(v) for v in self.layers], [np.zeros_like(v) for v in self.layers]
        for step in range(1, rounds + 1):
            a, b, c, d = self.layers
            h = np.tanh(z @ a + b)
            error = weight * (1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30))) - y)
            back = error[:, None] * c * (1 - h * h)
            slopes = [z.T @ back + decay * a, back.sum(0), h.T @ error + decay * c, error.sum()]
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.layers[i] = self.layers[i] - rate * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the least weighted log loss on rows the layers have not seen."""
        logit, tried = self.logit(x), np.geomspace(0.25, 8, 60)
        loss = [(weight * np.logaddexp(0, np.where(y == 1, -1, 1) * logit / t)).sum() for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, dims: int = 64, vocabulary: int = 20_000, least: int = 3, window: int = 2,
        sample_docs: int = 2000, sample_bytes: int = 1 << 16) -> dict:
    """Word vectors and network from training documents (doc_id, text) and labels (doc_id, quality)."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").distinct()
    totals = {r["quality"]: r["count"] for r in docs.select("doc_id").join(known, "doc_id").groupBy("quality").count().collect()}
    if len(totals) < 2:
        return {"share": float(next(iter(totals), 0.5))}
    drawn = staged(sample(docs, known, "quality", sample_docs, mean_bytes=sample_bytes).select(
        "quality", text_bytes().alias("text"), (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0).alias("apart")), "quality-sample")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter()
            for text in batch["text"]:
                words = set(text.split())
                seen.update(words)
                seen.update({shape(w) for w in words})
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    counted = drawn.select("text").mapInPandas(candidates, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(vocabulary)
    terms = sorted({REPEAT, UNKNOWN, *(bytes(r["term"]) for r in kept.collect())})

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = np.stack([index_vector(t, dims) for t in terms])
        numbers, sums = Terms(terms), np.zeros((len(terms), dims))
        for batch in batches:
            for at in range(0, len(batch), 100):
                ids, lengths = numbers.of(batch["text"].iloc[at:at + 100].tolist())
                ids, text = ids.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
                pairs = []
                for step in range(1, window + 1):
                    near = text[step:] == text[:-step]
                    left, right = ids[:-step][near], ids[step:][near]
                    pairs += [left * len(terms) + right, right * len(terms) + left]
                pairs, n = np.unique(np.concatenate(pairs), return_counts=True)
                term, other = pairs // len(terms), pairs % len(terms)
                own, first = np.unique(term, return_index=True)
                if len(own):
                    sums[own] += np.add.reduceat(index[other] * n[:, None].astype(np.float32), first)
        at, dim = np.nonzero(sums)
        yield pd.DataFrame({"term": at, "dim": dim, "n": sums[at, dim]})

    summed = drawn.select("text").mapInPandas(neighbours, "term long, dim int, n double").groupBy("term", "dim").agg(
        F.sum("n").alias("n")).toArrow()
    vectors = np.zeros((len(terms), dims), np.float32)
    vectors[summed.column("term").to_numpy(), summed.column("dim").to_numpy()] = summed.column("n").to_numpy()
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    model = {"terms": terms, "vectors": vectors}

    def represent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Terms(terms)
        for batch in batches:
            yield pd.DataFrame({"quality": batch["quality"], "apart": batch["apart"],
                                "vector": list(pooled(vectors, *numbers.of(batch["text"].tolist())).astype(float))})

    data = drawn.mapInPandas(represent, "quality int, apart boolean, vector array<double>").toArrow().to_pandas()
    x, y, apart = np.stack(data["vector"]), data["quality"].to_numpy(), data["apart"].to_numpy(bool)
    size = np.bincount(y, minlength=2)
    weight = np.where(y == 1, totals[1] / max(size[1], 1), totals[0] / max(size[0], 1))
    order = np.lexsort((*x.T, y))  # the rows come in any order; training must not depend on it
    x, y, apart, weight = x[order], y[order], apart[order], weight[order]
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart[:] = False
    network = Network(x[~apart], y[~apart], weight[~apart])
    network.calibrate(x[apart], y[apart], weight[apart]) if apart.any() else None
    return model | {"network": network}


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text): the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        numbers = Terms(model["terms"]) if "terms" in model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                scores = np.full(part.num_rows, model.get("share", 0.5))
                if numbers is not None:
                    texts = part.column("text").to_pylist()
                    scores = model["network"].probability(pooled(model["vectors"], *numbers.of(texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return map_texts(read, run, "doc_id long, score double")

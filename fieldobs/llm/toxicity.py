"""Toxicity by class-conditional Kneser-Ney models.

Two models over the bytes of words (``kneserney``), one of toxic and one of ordinary documents,
share their lower orders. A word's evidence is its log-likelihood ratio divided by its length
(and ``SHORT`` bytes more, since a short word says little); a document is as toxic as its
strongest words: the evidence of the ``strongest`` distinct words with the highest ratio is averaged. So one expression in a long text counts as in a short one, and
common words, alike in both classes, count nothing. A logistic curve turns evidence into a score;
it is fitted on documents the models have not seen.

The models are fitted on a bounded sample: at most ``sample_docs`` labelled training documents
of each class, by the smallest hash of the id, whole and of any length, until they have
``sample_docs * sample_bytes`` bytes. Each document counts a word once. Four fifths of them train
the models, one fifth the curve, or all of them both if one part lacks a class; both may be sent
to every task. Scoring reads every document and whole texts.

Defined cases: a text without words has no evidence and scores as low as the curve goes; if one
of the classes is missing from the sample, every score is the share of toxic labels (0 without
labels); repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.llm import ppm
from fieldobs.llm.common import map_texts, staged, text_bytes
from fieldobs.llm.kneserney import ClassModels
from fieldobs.llm.langid import sample


#: Bytes added to a word's length when its ratio is normalised.
SHORT = 4


class Evidence:
    """Length-normalised log-likelihood ratio of each word, remembered."""

    def __init__(self, models: ClassModels, remember: int = 300_000):
        self.models, self.remember = models, remember
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, float] = {}
        self.codes, self.ratios = ppm.word_codes([], self.models.order)[0], np.empty(0)

    def learn(self, words: list[bytes]) -> None:
        codes, starts = ppm.word_codes(words, self.models.order)
        distinct, inverse = np.unique(codes, return_inverse=True)
        new = np.setdiff1d(distinct, self.codes, assume_unique=True)
        likelihood = self.models.log_likelihood(new)
        every = np.concatenate([self.codes, new])
        by_code = np.argsort(every, kind="stable")
        self.codes = every[by_code]
        self.ratios = np.concatenate([self.ratios, likelihood[:, 1] - likelihood[:, 0]])[by_code]
        ratios = self.ratios[np.searchsorted(self.codes, distinct)][inverse]
        lengths = np.diff(np.append(starts, len(codes)))
        self.known.update(zip(words, (np.add.reduceat(ratios, starts) / (lengths + SHORT)).tolist()))

    def of(self, texts: list[bytes], strongest: int) -> np.ndarray:
        """Mean of the ``strongest`` highest ratios of each text's words; 0 stands for words it lacks."""
        if len(self.known) > self.remember:
            self.forget()
        words = [set(t.lower().split()) for t in texts]
        new = list(set().union(*words).difference(self.known))
        if new:
            self.learn(new)
        out = np.zeros(len(texts))
        for i, own in enumerate(words):
            ratios = sorted(map(self.known.__getitem__, own), reverse=True)[:strongest]
            out[i] = sum(max(r, 0.0) for r in ratios) / strongest
        return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    ridge = np.diag([1e-2, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge @ beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        beta = beta + np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, order: int = 7, sample_docs: int = 1500, sample_bytes: int = 1 << 16,
        strongest: int = 2) -> dict:
    """The models and the curve from training documents (doc_id, text) and labels (doc_id, toxic)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, part in batch.groupby("toxic"):
                seen = Counter(w for text in part["text"] for w in set(text.lower().split()))
                codes, starts = ppm.word_codes(list(seen), order)
                n = np.repeat(list(seen.values()), np.diff(np.append(starts, len(codes))))
                distinct, inverse = np.unique(codes, return_inverse=True)
                yield pd.DataFrame({"toxic": toxic, "code": distinct.view(np.int64),
                                    "n": np.bincount(inverse, n, len(distinct)).astype(np.int64)})

    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    drawn = sample(docs, known, "toxic", sample_docs, mean_bytes=sample_bytes)
    rows = staged(drawn.select("toxic", text_bytes().alias("text"), (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0).alias("curve")), "toxicity-sample")
    parts = {(r["toxic"], r["curve"]): r["count"] for r in rows.groupBy("toxic", "curve").count().collect()}
    sizes = {c: sum(n for (toxic, _), n in parts.items() if toxic == c) for c in (0, 1)}
    apart = len(parts) == 4  # else a class is missing on one side, and all rows serve for both
    trained, curved = (rows.where("not curve"), rows.where("curve")) if apart else (rows, rows)
    counted = trained.select("toxic", "text").mapInPandas(count, "toxic int, code long, n long").groupBy("code").agg(
        *[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).cast("double").alias(f"n{c}") for c in (0, 1)]).toArrow()
    counts = [counted.column(f"n{c}").to_numpy() for c in (0, 1)]
    if not all(c.sum() for c in counts):
        return {"share": sizes[1] / max(sum(sizes.values()), 1)}
    codes = counted.column("code").to_numpy().view(ppm.word_codes([], order)[0].dtype)
    models = ClassModels(codes, counts, order)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(sent.value)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": evidence.of(batch["text"].tolist(), strongest)})

    curve = curved.select("toxic", "text").mapInPandas(weigh, "toxic int, x double").orderBy("x", "toxic").toArrow()
    return {"models": models, "strongest": strongest,
            "curve": logistic(curve.column("x").to_numpy(), curve.column("toxic").to_numpy().astype(float))}


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        evidence = Evidence(model["models"]) if "models" in model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = np.full(part.num_rows, model.get("share", 0.0))
                if evidence is not None:
                    slope, intercept = model["curve"]
                    x = evidence.of(part.column("text").to_pylist(), model["strongest"])
                    scores = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return map_texts(read, run, "doc_id long, score double")

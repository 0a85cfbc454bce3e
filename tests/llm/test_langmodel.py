"""Languages learned from all labelled documents, against trees held whole."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fieldobs.llm import langid, langmodel
from fieldobs.llm.common import table

SF = "/root/testdata/sf0.001"


def halves():
    return F.pmod(F.xxhash64(F.lit(5), F.coalesce("text", F.lit(""))), F.lit(2))


def test_bits_and_limits_are_those_of_whole_trees(spark, monkeypatch):
    half = halves()
    docs = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS).withColumn(
        "lang", F.when((F.col("lang") != "es") | (half == 0), F.col("lang")))  # one half alone has es
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "  ", None, None, 2)], docs.schema))
    monkeypatch.setattr(langmodel, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(langmodel, "SHARD_CODES", 5_000)
    langs, measured = langmodel.measure(docs, half)
    limits = langmodel.limits(langs, measured)
    rows = {r.doc_id: r for r in measured.collect()}
    assert langs == ["de", "en", "es", "fr"] and len(rows) == docs.count()
    learned = [langid.fit(docs, half == i, sample_docs=10**9) for i in (0, 1)]
    for fold in (0, 1):
        tries = learned[fold] | learned[1 - fold]
        own = [r for r in rows.values() if r.fold == fold]
        bits = langid.WordCosts([tries[lang] for lang in langs]).totals([(r.text or "").encode().lower().split() for r in own])
        assert np.allclose(np.array([r.bits for r in own]) / langmodel.UNIT, bits, rtol=1e-4, atol=0.01)
        for lang, (median, limit) in langid.limits(docs, half == fold, tries, sample_docs=10**9).items():
            assert np.allclose(limits[fold, lang], (median, limit), atol=0.01), (fold, lang)


def test_the_language_stage_leaves_no_document_out_of_its_models(spark, monkeypatch):
    """It took 1,500 documents a language, and 500 for its limits."""
    def refuse(*args, **kwargs):
        raise AssertionError("a sample")

    monkeypatch.setattr(langid, "sample", refuse)
    assert corpus_pipeline.language(spark, table(spark, SF, "documents"), SF).count() > 0

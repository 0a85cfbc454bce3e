"""What the stages leave in the work folder, and how often they shuffle the texts."""

import itertools
import os
import re

import pytest

import corpus_pipeline
from fieldobs.llm import common, mixing, neardup
from fieldobs.llm.common import scratch, staged, table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(monkeypatch, tmp_path):
    numbers = itertools.count()
    monkeypatch.setattr(common, "work_dir", lambda spark, purpose: f"file://{tmp_path}/{purpose}-{next(numbers)}")
    return lambda: sorted(re.sub("-[0-9]+$", "", name) for name in os.listdir(tmp_path))


@pytest.fixture
def shuffling(spark):
    """No join is small enough to broadcast unless the sizes of its tables are known."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def text_shuffles(df):
    plan = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return sum(bool(re.search(r"\b(text|row|first)#", part)) for part in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan))


def test_stages_leave_only_what_their_result_reads(spark, folder):
    docs = table(spark, SF, "documents")
    first = corpus_pipeline.language(spark, docs, SF)
    assert folder() == ["measured"]
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert folder() == ["measured", "near-duplicates"]
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert folder() == ["measured", "mix-sources", "mix-starts", "near-duplicates"]
    for frame in (first, kept, mixed):
        assert frame.count() > 0


def test_scratch_frames_stay_for_the_block_around(spark, folder):
    with scratch(spark) as keep:
        staged(spark.range(3), "outer")
        with scratch(spark) as keep_inner:
            staged(spark.range(3), "inner")
            got = keep_inner(spark.range(4), "stays")
        assert folder() == ["outer", "stays"] and got.count() == 4
        got = keep(got, "result")
    assert folder() == ["result"] and got.count() == 4
    with pytest.raises(ValueError), scratch(spark) as keep:
        staged(spark.range(3), "lost")
        raise ValueError
    staged(spark.range(1), "plain")
    assert folder() == ["plain", "result"]


def test_texts_are_shuffled_once(spark, shuffling):
    docs = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    assert text_shuffles(neardup.dedup(docs)) == 1
    assert text_shuffles(mixing.mix(docs, keep=("text", "lang"))) == 1


def test_rows_that_repeat_an_id_are_told_apart_by_text(spark):
    rows = [(1, "a b", "en"), (1, "a b", "en"), (1, "c d", "en"), (None, None, "en"), (None, None, "en"), (None, "", "en"),
            (0, None, "en"), (0, "e f", "en"), (None, "e f", "de"), (2, "a b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = neardup.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(
        f"Row(doc_id={i!r}, text={t!r})" for i, t in [(1, "a b"), (1, "c d"), (None, None), (None, ""), (0, None), (0, "e f")])

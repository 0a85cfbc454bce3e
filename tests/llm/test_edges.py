"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldobs.llm import ann, langid, linededup, lmscore, mixing, neardup, packing, quality, topk, toxicity
from fieldobs.llm.common import id_remainder

CLASHING = ["size", "key", "bucket", "block", "n", "cid", "value", "pos", "freq", "rank", "component", "row", "text_hash",
            "held_out", "bundle", "kept_0", "vector", "id", "chunk", "score", "copy", "cut", "epochs", "removed", "w", "draw"]
LONG = " ".join(f"w{i % 977}" + ("\n" if i % 50 == 0 else "") for i in range(30_000))
ROWS = [
    (None, None, None, None, None), (None, "words without an id", "en", "a", 19), (1, "", "en", "a", 0), (2, " \n\t \n\n", "en", None, 6),
    (3, "123 456 !!!\n789", None, "b", 15), (4, LONG, "en", "b", len(LONG)), (5, "one two three\nfour\nfive six", "en", "a", 27),
    (6, "one two three\nfour\nfive six", "en", "a", 27), (6, "one two three\nfour\nfive six", "en", "a", 27),
    (7, "nul \x00 byte <|endoftext|> <|STARTOFTEXT|> Été \U0001f600 x y", "fr", "c", 40), (8, "one two three\nfour\nfive seven", "en", "a", 29),
    (9_007_199_254_740_993, "a large id", "en", "c", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def labels(docs, name):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias(name))


RUNS = {
    "lines": lambda d: linededup.dedup_lines(d),
    "lm": lambda d: lmscore.score(d, id_remainder(F.col("doc_id"), 7) == 2),
    "near": lambda d: neardup.near_duplicates(d),
    "quality": lambda d: quality.score(d, quality.fit(d, labels(d, "quality"))),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels(d, "toxic"))),
    "mix": lambda d: mixing.mix(d),
    "language": lambda d: langid.identify(d, langid.fit(d, F.lit(True))),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_a_document(docs, name):
    rows = RUNS[name](docs).collect()
    ids = sorted(r["doc_id"] or 0 for r in rows)
    assert ids == sorted(r[0] or 0 for r in ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(none, name):
    assert RUNS[name](none).collect() == []


def test_lines_cases(docs):
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert got[None, None] == (0, 0) and got[1, ""] == (1, 0) and got[6, ""] == (3, 3)
    assert got[5, ROWS[6][1]] == (3, 0) and got[8, ROWS[10][1]] == (3, 0) and got[2, ROWS[3][1]] == (4, 0)


def test_near_cases(docs):
    got = sorted(tuple(r)[:4] for r in neardup.near_duplicates(docs).collect() if r.doc_id is not None)
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[1] == (0, 1, True) and by_id[2] == (0, 2, True)
    assert by_id[6] == (2, 5, False) and by_id[5] == (2, 5, True) and by_id[8][1] == 8
    kept = neardup.dedup(docs.where("doc_id = 6"))
    assert kept.count() == 1 and kept.columns == docs.columns


def test_language_cases(docs):
    got = {r.doc_id: r for r in RUNS["language"](docs).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[3].score == 0
    assert got[5].lang_pred == "en" and 0 < got[5].score <= 1


def test_scores_without_labels(docs):
    unlabelled = docs.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.lit(None).cast("int").alias("quality"))
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, unlabelled)).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, quality.fit(docs, unlabelled)).collect()} == {0.5}
    one = unlabelled.withColumn("quality", F.lit(1))
    assert {r.score for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1.0}


def test_packing_cases(docs, none):
    rows = packing.pack(docs, PATH, capacity=512).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert max(r.piece for r in rows if r.doc_id == 4) > 50
    assert packing.pack(none, PATH).collect() == []


VECTORS = [(None, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]),
           (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [-1.0, 0.5]), (10, [1.0, 2.0, 3.0])]


def test_vector_cases(spark):
    table = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in CLASHING])
    near = [tuple(r) for r in ann.nearest(table, table.where("vec_id = 0"), k=5).collect()]
    assert [r[:3] for r in near] == [(0, 1, 7), (0, 2, 8), (0, 3, 9)]
    assert near[0][3] == pytest.approx(2 ** -0.5) and near[2][3] == pytest.approx(-1 / 1.25 ** 0.5)
    best = [tuple(r) for r in topk.top_products(table, table.where("vec_id in (0, 1)"), k=2).orderBy("query_id", "rank").collect()]
    assert best == [(0, 1, 8, 8192), (0, 2, 7, 4096), (1, 1, 0, 0), (1, 2, 7, 0)]
    empty = table.limit(0)
    assert ann.nearest(empty, empty).collect() == [] and topk.top_products(table, empty).collect() == []


def test_stages_on_edge_rows(spark, docs, none):
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            now = spark.createDataFrame(now.collect(), now.schema)
            if name != "pack":
                assert now.columns == corpus_pipeline.COLUMNS
        assert (now.count() > 0) == (start is docs)

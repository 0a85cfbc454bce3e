"""Languages and classes that only long texts, or few rows, have are learned."""

from pyspark.sql import functions as F

from fieldobs.llm import langid, quality, toxicity

LONG = 70_000


def repeated(words: str, least: int) -> str:
    return (words + " ") * (least // len(words) + 1)


def test_language_of_long_texts_only(spark):
    rows = [(i, repeated("the cat and the dog were here", 100 + i), "en") for i in range(30)]
    rows += [(100 + i, repeated("perché gli uccelli cantano così bene", LONG + i), "it") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tries = langid.fit(docs, F.lit(True))
    told = langid.identify(docs, tries).where("doc_id >= 100").collect()
    assert set(tries) == {"en", "it"} and {r.lang_pred for r in told} == {"it"}


def test_sample_is_bounded_by_bytes_but_never_empty(spark):
    rows = [(i, "x" * (5000 if i % 2 else 10), "long" if i % 2 else "short") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid.sample(docs.drop("lang"), docs.drop("text"), "lang", 50, mean_bytes=20)
    assert {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()} == {"short": 50, "long": langid.FIRST}


def classes(spark, toxic):
    rows = [(i, repeated(f"a calm and friendly text number w{i}", 200)) for i in range(40)] + toxic
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") >= 1000).cast("int").alias("label"))


def test_toxic_class_of_long_texts_or_one_row(spark):
    for toxic in ([(1000 + i, repeated("a calm scumbag text", LONG)) for i in range(12)], [(1000, "you scumbag scumbag idiot")]):
        docs, labels = classes(spark, toxic)
        scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.withColumnRenamed("label", "toxic"))).collect()}
        assert min(scored[i] for i, _ in toxic) > max(v for i, v in scored.items() if i < 1000)


def test_quality_class_of_long_texts_only(spark):
    docs, labels = classes(spark, [(1000 + i, repeated("buy now click here", LONG)) for i in range(12)])
    scored = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels.withColumnRenamed("label", "quality"))).collect()}
    assert min(v for i, v in scored.items() if i >= 1000) > max(v for i, v in scored.items() if i < 1000)

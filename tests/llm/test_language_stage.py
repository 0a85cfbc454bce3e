"""The language stage decides by its model: which documents go, and what language the others are in."""

import corpus_pipeline
from fieldobs.llm.common import table

SF = "/root/testdata/sf0.01"


def test_language_stage_rejects_and_relabels(spark):
    docs = table(spark, SF, "documents")
    long = {r.lang: r for r in docs.where("n_chars between 500 and 5000").orderBy("doc_id").collect()}
    far = ["xqzt vbnkw qqjx zzkp wvxq hjkq zxcv bnmq " * 5, "4711 0815 %%% x 9321 #### 5550 [[[ 7777 ]]] 1234 @@@@ 8642",
           "Τα παιδιά πηγαίνουν στο σχολείο κάθε πρωί με το λεωφορείο", "これは日本語の文章です。今日は天気がいいですね。"]
    rows = [(10_000_000 + i, t, "en", "s", len(t)) for i, t in enumerate(far)]
    wrong = {"en": "de", "de": None, "fr": "en", "es": "fr"}
    rows += [(20_000_000 + i, r.text, wrong[lang], "s", r.n_chars) for i, (lang, r) in enumerate(sorted(long.items()))]
    rows += [(30_000_000, "A.", "en", "s", 2)]
    added = spark.createDataFrame(rows, docs.schema)
    got = {r.doc_id: r for r in corpus_pipeline.language(spark, docs.unionByName(added), SF).collect()}
    assert [i for i in got if 10_000_000 <= i < 20_000_000] == []
    assert [got[20_000_000 + i].lang for i in range(4)] == sorted(long)
    lettered = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert lettered <= set(got) and 30_000_000 in got

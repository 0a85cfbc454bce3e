"""Fill-in-the-middle: against a plain version, and there and back."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from fieldobs.llm import fim
from fieldobs.llm.common import table


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(rows, frame):
    got = fim.restore(fim.transform(frame)).collect()
    want = sorted((((i is not None, i or 0), *plain(i, t), t or "") for i, t in rows), key=repr)
    have = sorted((((r.doc_id is not None, r.doc_id or 0), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)
                   for r in got), key=repr)
    assert have == want
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
    return {r.form for r in got}


def test_equals_plain_version(spark):
    draw = random.Random(1)
    letters = "abzAZ é中\U0001f600\n\t1@[`{<>PSM"
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))) for i in range(400)]
    rows += [(None, None), (None, "no id"), (1, ""), (500, "<P"), (501, "S><M>"), (501, "S><M>"), (502, "x<S<P"), (503, "M>"),
             (504, "word " * 40_000), (9_007_199_254_740_993, "é")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("output"), F.lit(1).alias("n"))
    assert check(rows, frame.repartition(3)) == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(frame.limit(0))).collect() == []


def test_whole_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], docs)


def test_cutting_splits_descriptors():
    made = fim.PieceTable(b"abcdef").cut(2, 2, 6)
    assert made.pieces == [(0, 0, 2), (0, 2, 0), (0, 2, 4), (0, 6, 0)]
    three = fim.PieceTable(b"abcdef").cut(1, 4)
    assert three.arranged("SPM").read() == b"<S>ef<P>a<M>bcd"
    assert three.arranged("SPM").in_order("SPM").pieces == three.pieces
    assert three.arranged("PSM").cut(2).read() == b"<P>a<S>ef<M>bcd"


def test_all_documents_cut_or_none(spark):
    docs = spark.createDataFrame([(i, f"word {i} and more") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in fim.transform(docs, percent=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(docs, percent=100, spm_percent=100).collect()} == {"spm"}

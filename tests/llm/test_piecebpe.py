"""Piece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fieldobs.llm import piecebpe, queries
from fieldobs.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return piecebpe.PieceEncoder(PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_rounds_equal_the_library(library, encoder):
    draw = random.Random(5)
    texts = ["", " ", "   ", "a", "▁a ▁", "a\n\n b   c\t\td", "é①ﬁ 中文字", "a" * 333, " " * 100 + "x" + " " * 37,
             "\x00\x01<s></s><unk><0x0A>", "the" * 70, "ACGT" * 90, "\U0001f600�\x7f\x80"]
    for letters, size in (("abcdefghinorstu  ▁\n.,'éàüñ中文\U0001f600012ABC", 60), ("ab ", 150), ("ion tera", 250), (" ▁a", 40)):
        texts += ["".join(draw.choice(letters) for _ in range(draw.randint(0, size))) for _ in range(400)]
    got = [i for group in piecebpe._groups([t.encode() for t in texts], 999) for i in encoder(group)]
    assert [ids(g) for g in got] == library.encode(texts)
    assert [piecebpe.text_of(encoder.pieces, np.frombuffer(g, "<u4")) for g in got] == [library.decode(ids(g)) for g in got]


def test_long_stretches(library, encoder):
    draw = random.Random(6)
    for letters in (" ", "a", "ACGT", "etaoinsrh", "中文字天地人日月"):
        text = "".join(draw.choice(letters) for _ in range(20_000))
        assert ids(encoder([text.encode()])[0]) == library.encode(text)
    assert max(map(len, encoder.ids)) <= encoder.longest


def test_memory_of_stretches_is_bounded(library):
    small = piecebpe.PieceEncoder(PATH, remember=50, keep=10)
    for n in range(40):
        text = " ".join(f"w{n}x{k}" for k in range(30))
        assert ids(small([text.encode()])[0]) == library.encode(text)
        assert len(small.ids) < 200


def test_decoding_any_ids(library, encoder):
    draw = random.Random(7)
    kinds = [lambda: draw.choice([0, 1, 2, 29871]), lambda: draw.randint(3, 258), lambda: draw.randint(130, 258), lambda: draw.randint(259, 31999)]
    for _ in range(1500):
        some = [draw.choice(kinds)() for _ in range(draw.randint(0, 12))]
        assert piecebpe.text_of(encoder.pieces, np.array(some, "<u4")) == library.decode(some)


def test_query_equals_the_library(spark, library):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = []
    for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect():
        i = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(i), sha(np.array(i, "<u4").tobytes()), sha(library.decode(i).encode())))
    got = queries.op12_piece_encoding(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_defined_cases(spark, library):
    rows = [(None, None), (None, "no id"), (1, ""), (2, "same"), (2, "same"), (3, "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("ids"), F.lit("y").alias("n_tokens"))
    got = piecebpe.decode(piecebpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, ids(r.ids), r.decoded) for r in got) == sorted(
        (i or 0, library.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t in rows)
    assert piecebpe.decode(piecebpe.encode(docs.limit(0), PATH), PATH).collect() == []
    bare = piecebpe.encode(docs.where("doc_id = 2"), PATH, begin=False, end=False).first()
    assert ids(bare.ids) == library.encode("same") and bare.n_tokens == len(library.encode("same"))

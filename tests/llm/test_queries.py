"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import re
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import check
import corpus_pipeline
from fieldobs.llm import queries
from fieldobs.llm.common import staged, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    result = check.compare(spark, check.oracle(SF), SF, name)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


CONTRACT = {
    "op1_ann_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
                       "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint",
                             "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_columns(spark, name):
    assert dict(entry.queries()[name](spark, SF).dtypes) == CONTRACT[name]


def test_held_out_rows(spark):
    for name, modulus, rest in (("op4_lm_scoring", 7, 2), ("op8_toxicity", 5, 0)):
        for r in queries.QUERIES[name](spark, SF).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = staged(stage(spark, docs, SF), "stage")
        out.append((name, docs.collect(), made.collect()))
        docs = made
    return out


def test_stage_language(stages):
    name, before, after = stages[0]
    lettered = {r for r in before if r.text and any(c.isalpha() for c in r.text)}
    assert name == "language" and set(after) == lettered


def test_stage_lines(stages):
    from tests.llm.test_mix_pack_lines import plain_lines

    _, before, after = stages[1]
    want = plain_lines([(r.doc_id, r.text) for r in before])
    same = {r.doc_id: r for r in before}
    want = {i: t for i, t in want.items() if t.split() or t == same[i].text}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (same[r.doc_id].lang, same[r.doc_id].source) for r in after)


def test_stage_near_duplicates(stages):
    from tests.llm.test_neardup import brute

    _, before, after = stages[2]
    kept = {i for i, _, _, keep in brute([(r.doc_id, r.text) for r in before], 5, 80) if keep}
    assert {r for r in before if r.doc_id in kept} == set(after) and len(after) == len(kept)


def test_stage_mix(stages):
    from tests.llm.test_mix_pack_lines import plain_mix

    _, before, after = stages[3]
    *_, taken = plain_mix([(r.doc_id, r.text, r.source) for r in before])
    words, text = defaultdict(int), {r.doc_id: r.text for r in before}
    for r in after:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in taken.items() if n}


def test_stage_pack(stages):
    _, before, after = stages[4]
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == tokens and {r.doc_id for r in after} == {r.doc_id for r in before}
    fill = defaultdict(int)
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_run_gives_the_stages_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, bytes(r.ids))
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[4][2]))

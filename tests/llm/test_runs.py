"""Periodic runs against the definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldobs.llm import queries, runs
from fieldobs.llm.common import table


def plain_runs(words, least=12):
    """Every period's maximal stretches; a stretch counts for its smallest period only."""
    n, seen, found = len(words), {}, []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            # A longer period that covers the same or a part of a run of a divisor is no smallest period.
            if length >= 2 * q and not any(q % p == 0 and s <= i and i + length <= e for s, e, p in seen.get(i, []) + [
                    r for rs in seen.values() for r in rs]):
                seen.setdefault(i, []).append((i, i + length, q))
                if length >= least:
                    found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def strings():
    draw = random.Random(9)
    yield from (list("a" * 30), list("ab" * 12), list("aab" * 9 + "aac"), fibonacci(300), list("abcabcabcabd" * 6))
    yield [bin(i).count("1") % 2 for i in range(256)]
    for size, letters in ((14, "ab"), (40, "ab"), (90, "ab"), (60, "abc"), (150, "a" * 9 + "b")):
        for _ in range(60):
            yield [draw.choice(letters) for _ in range(size)]
    for _ in range(60):  # mixed blocks of repeats
        words = []
        while len(words) < 120:
            block = [draw.choice("abcd") for _ in range(draw.randint(1, 9))]
            words += block * draw.randint(1, 6) + block[:draw.randint(0, len(block))]
        yield words


@pytest.mark.parametrize("least", [12, 2, 7])
def test_runs_equal_the_definition(least):
    for words in strings():
        got = runs.find(runs.numbered(words), least)
        assert got == plain_runs(words, least), (words, least)


def test_a_long_period_and_a_long_run():
    assert runs.find(np.tile(np.arange(5_000), 3)[:14_000]) == [(0, 14_000, 5_000)]
    assert runs.find(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert runs.find(np.arange(100)) == [] and runs.find(np.zeros(0, np.int64)) == []
    assert runs.find(np.zeros(11, np.int64)) == [] and runs.find(np.zeros(12, np.int64)) == [(0, 12, 1)]


def test_ordered_positions():
    draw = random.Random(3)
    some = draw.sample(range(100_000), 9_000)
    held = runs.Positions(some[0])
    for p in some[1:]:
        held.add(p)
    assert list(held) == sorted(some) and held.size == len(some) and max(map(len, held.chunks)) <= 2 * held.CHUNK
    for p in draw.sample(sorted(set(range(100_000)) - set(some)), 500):
        before, behind = held.around(p)
        assert before == max((x for x in some if x < p), default=None)
        assert behind == min((x for x in some if x > p), default=None)


def test_query_equals_the_definition(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect())
    small = [tuple(r) for r in docs.collect() if len((r.text or "").split()) < 800]
    ids = {i for i, _ in small}
    assert len(small) > 150
    assert [r for r in rows if r[0] in ids] == sorted(plain_row(*r) for r in small)


def test_defined_cases(spark):
    rows = [(None, None), (None, "x " * 20), (1, ""), (2, " \n\t"), (3, "a b " * 9), (3, "a b " * 9),
            (21, "one two three\x0bfour\x1cfive " * 5), (22, "é è  " * 13)]
    rows += [(i, " ".join(f"w{k * k % 37}" for k in range(i % 50))) for i in range(30, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", *[F.lit("x").alias(c) for c in ("runs", "collapsed", "n", "h", "g", "a", "p", "words")])
    got = runs.digest(runs.collapse(runs.planted(docs.repartition(3)))).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r[:2]) + r[-2:]
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(*r) for r in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    assert runs.digest(runs.collapse(runs.planted(docs.limit(0)))).collect() == []


def test_collapsed_text_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "x y z\n" * 5 + "end", "s")], "doc_id long, text string, source string")
    row = runs.collapse(docs).first()
    assert row.collapsed == "x y z end" and row.source == "s" and row.text == "x y z\n" * 5 + "end"
    assert [tuple(r) for r in row.runs] == [(0, 15, 3)]

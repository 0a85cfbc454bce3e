"""Near duplicates and components against brute force."""

import random

import pytest

from fieldobs.llm import neardup
from fieldobs.llm.components import components, joined


def words(draw, n):
    return ["".join(draw.choices("abcdefgh", k=4)) for _ in range(n)]


def edited(draw, text, edits):
    text = list(text)
    for at in draw.sample(range(len(text)), edits):
        text[at] = "".join(draw.choices("mnopq", k=4))
    return text


def corpus(seed=5):
    """Unrelated texts, a shared passage, small groups, and one large group of copies with few to many edits."""
    draw = random.Random(seed)
    passage, origin = words(draw, 60), words(draw, 150)
    docs = [words(draw, draw.randint(0, 40)) for _ in range(40)]
    docs += [words(draw, 30) + passage + words(draw, 30) for _ in range(60)]
    docs += [edited(draw, origin, draw.randint(0, 14)) for _ in range(150)]
    for _ in range(15):
        base = words(draw, draw.randint(4, 400))
        docs += [edited(draw, base, min(draw.randint(0, 6), len(base))) for _ in range(draw.randint(1, 4))]
    docs += [docs[45], docs[120], docs[120], ["one"], ["one"], ["one", "two"], []]
    draw.shuffle(docs)
    return [(i * 3, " ".join(d).title() if i % 7 == 0 else "\n".join(d)) for i, d in enumerate(docs)]


def brute(rows, n_words, percent):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[j:j + n_words]) for j in range(len(w) - n_words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("n_words,percent,short", [(3, 85, 32), (3, 85, 4), (5, 80, 4), (2, 50, 8)])
def test_equals_brute_force(spark, n_words, percent, short):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.near_duplicates(docs, n_words, percent, short=short).drop("text_hash")
    assert {tuple(r) for r in got.collect()} == brute(rows, n_words, percent)


def test_small_sketches_still_link(spark):
    rows = corpus(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, 3, 85, k=32, short=16).drop("text_hash")
    assert {tuple(r) for r in got.collect()} == brute(rows, 3, 85)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(i, 1000) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (5, 3), (3, 5)], "a long, b long")
    got = {tuple(r) for r in components(edges).collect()}
    want = {(i, 100) for i in range(100, 141)} | {(i, 200) for i in [*range(200, 260), 1000]} | {(3, 3), (5, 3)}
    assert got == want
    assert components(edges.limit(0)).collect() == []
    more = spark.createDataFrame([(130, 230), (5, 50), (60, 61)], "a long, b long")
    want = {(i, 100) for i, c in want if c >= 100} | {(3, 3), (5, 3), (50, 3), (60, 60), (61, 60)}
    assert {tuple(r) for r in joined(components(edges), more).collect()} == want
    assert {tuple(r) for r in joined(components(edges), more.limit(0)).collect()} == got

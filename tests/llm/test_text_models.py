"""Language models, classifiers and their parts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldobs.llm import bytecontexts, langid, lmscore, ppm, quality, toxicity
from fieldobs.llm.common import id_remainder, table
from fieldobs.llm.kneserney import ClassModels

DATA = "/root/testdata"
SYMBOLS = [b for b in range(256) if b not in (9, 10, 11, 12, 13)]


class PlainTrie:
    """Prediction by partial matching as the books have it: one set of excluded symbols, one context at a time."""

    def __init__(self, words: Counter, order: int):
        self.order, self.after = order, defaultdict(Counter)
        for word, n in words.items():
            text = b" " + word + b" "
            for i in range(1, len(text)):
                for k in range(order + 1):
                    if k <= i:
                        self.after[text[i - k:i]][text[i]] += n

    def probability(self, before: bytes, symbol: int) -> float:
        p, excluded = 1.0, set()
        for k in range(min(self.order, len(before)), -1, -1):
            seen = {s: n for s, n in self.after.get(before[len(before) - k:], {}).items() if s not in excluded}
            if not seen:
                continue
            total = sum(seen.values())
            if symbol in seen:
                return p * (seen[symbol] - 0.5) / total
            p *= 0.5 * len(seen) / total
            excluded |= set(seen)
        return p / (ppm.ALPHABET - len(excluded))

    def bits(self, word: bytes) -> float:
        text = b" " + word + b" "
        return -sum(math.log2(self.probability(text[:i], text[i])) for i in range(1, len(text)))


def trie_of(words: Counter, order: int) -> ppm.Trie:
    codes, starts = ppm.word_codes(list(words), order)
    n = np.repeat(list(words.values()), np.diff(np.append(starts, len(codes))))
    distinct, inverse = np.unique(codes, return_inverse=True)
    return ppm.Trie(distinct, np.bincount(inverse, n), order)


WORDS = Counter({b"the": 9, b"then": 3, b"other": 2, b"thermal": 1, b"a": 5, b"\xc3\xa9t\xc3\xa9": 2, b"a\x00b": 1, b"aaaaaaaaaa": 1})


@pytest.mark.parametrize("order", [0, 1, 3, 4, 6])
def test_trie_equals_plain_partial_matching(order):
    trie, plain = trie_of(WORDS, order), PlainTrie(WORDS, order)
    asked = [*WORDS, b"they", b"zebra", b"x", b"aaaa\xff", b"hermes", b"\x00"]
    codes, starts = ppm.word_codes(asked, order)
    got = np.add.reduceat(trie.cost(codes), starts)
    assert got == pytest.approx([plain.bits(w) for w in asked])


def test_probabilities_sum_to_one():
    trie = trie_of(WORDS, 4)
    for word in (b"t", b"th", b"othe", b"qq", b"aaaaaa"):
        codes = np.array([ppm.word_codes([word + bytes([s])], 4)[0][len(word)] if s != 32 else
                          ppm.word_codes([word], 4)[0][-1] for s in SYMBOLS])
        assert np.exp2(-trie.cost(codes)).sum() == pytest.approx(1)


def test_class_models_sum_to_one_and_agree_on_the_unseen():
    words = [b"the", b"then", b"other", b"scum", b"scummy"]
    codes, starts = ppm.word_codes(words, 7)
    distinct, inverse = np.unique(codes, return_inverse=True)
    lengths = np.diff(np.append(starts, len(codes)))
    counts = [np.bincount(inverse, np.repeat(c, lengths), len(distinct)) for c in ([5.0, 2, 3, 0, 0], [4.0, 2, 2, 3, 1])]
    models = ClassModels(distinct, counts, 7)
    for word in (b"s", b"sc", b"the", b"qq"):
        codes = np.array([ppm.word_codes([word + bytes([s])], 7)[0][len(word)] if s != 32 else
                          ppm.word_codes([word], 7)[0][-1] for s in SYMBOLS])
        assert np.exp(models.log_likelihood(codes)).sum(0) == pytest.approx([1, 1])
    ratio = np.diff(models.log_likelihood(ppm.word_codes([b"scum"], 7)[0]), axis=1).sum()
    assert ratio > 3
    unseen = models.log_likelihood(ppm.word_codes([b"\xf0\xf1"], 7)[0][1:])
    assert unseen[:, 0] == pytest.approx(unseen[:, 1])


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "The cat sat on the mat", "a cat and a dog", "zebra crossing the road",
         "", None, "the the the the", "on the road again\nand again", "one two three four five six seven eight nine ten"] * 2


class PlainContexts:
    """Byte contexts over running text as the books have it: one context, one set of excluded bytes at a time."""

    ALPHABET = 252

    def __init__(self, texts: list[bytes], order: int = 6):
        self.order, self.after = order, [defaultdict(Counter) for _ in range(order + 1)]
        for text in texts:
            whole = b"\n" * order + text
            for i in range(order, len(whole)):
                self.after[order][whole[i - order:i]][whole[i]] += 1
        for k in range(order - 1, -1, -1):  # in how many longer contexts a byte follows
            for context, seen in self.after[k + 1].items():
                for symbol in seen:
                    self.after[k][context[1:]][symbol] += 1
        self.escapes = [self.estimate(level) for level in self.after]

    @staticmethod
    def kind(t: int, s: int) -> tuple[int, int]:
        return (t if t <= 24 else min(24 + math.ceil(4 * math.log2(t / 24)), 199),
                s if s <= 6 else min(6 + math.ceil(2 * math.log2(s / 6)), 63))

    def estimate(self, level):
        novel, seen = Counter(), Counter()
        for counts in level.values():
            t, s = sum(counts.values()), len(counts)
            for c in counts.values():
                if t > 1 and c == 1:
                    novel[self.kind(t - 1, s - 1)] += 1
                elif t > 1:
                    seen[self.kind(t - 1, s)] += c
        return lambda t, s: (novel[self.kind(t, s)] + 0.5) / (novel[self.kind(t, s)] + seen[self.kind(t, s)] + 1)

    def log10(self, before: bytes, symbol: int) -> float:
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = self.after[k].get(before[len(before) - k:])
            if not counts:
                continue
            left = sum(c for x, c in counts.items() if x not in excluded)
            leave = self.escapes[k](sum(counts.values()), len(counts))
            if symbol in counts:
                return math.log10(p * (1 - leave) * counts[symbol] / left)
            p *= leave if left else 1
            excluded = set(counts)
        return math.log10(p / (self.ALPHABET - len(excluded)))

    def score(self, text: bytes) -> list[float]:
        whole = b"\n" * self.order + text
        return [self.log10(whole[:i], whole[i]) for i in range(self.order, len(whole))]


def plain_scores(rows, phrase_words):
    """The model of ``lmscore``, document by document."""
    docs = [(i, zlib.crc32(str(i).encode()) % 7 == 2, (t or "").encode().lower().split()) for i, t in rows]

    def cut(tokens):
        out, now = [], []
        for w in tokens:
            now.append(w)
            if lmscore.stop_words(lmscore.word_hashes([w]), phrase_words)[0]:
                out.append(b" ".join(now))
                now = []
        return [*out, b" ".join(now) + b"\n"]

    words, phrases = Counter(), Counter()
    for _, held, tokens in docs:
        if not held:
            words.update([*tokens, b""])
            phrases.update(cut(tokens))
    n, v = sum(words.values()), len(words)
    once, twice = sum(c == 1 for c in phrases.values()), sum(c == 2 for c in phrases.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    plain = PlainContexts([b" ".join(t) + b"\n" for _, held, t in docs if not held])
    for i, held, tokens in docs:
        mine = Counter() if held else Counter(cut(tokens))
        others = Counter({p: c - mine[p] for p, c in phrases.items() if c > mine[p]})
        total, escaped, score, at = sum(others.values()), 0, 0.0, 0
        costs = plain.score(b" ".join(tokens) + b"\n")
        for k, p in enumerate(cut(tokens)):
            size = len(p) + (not p.endswith(b"\n") and at + len(p) < len(costs) - 1)
            if p == b"\n" and at == len(costs):  # the end went with the last stop word's separator
                size = 0
            escape = (escaped + 2 * d * len(others) / total) / (k + 2) if total else 1.0
            if others[p]:
                score += math.log10((1 - escape) * (others[p] - d) / (total - d * len(others)))
            else:
                score += math.log10(escape) + sum(costs[at:at + size])
                escaped += 1
            at += size
        assert at == len(costs)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in [*tokens, b""])
        yield i, held, len(tokens) + 1, sum(words[w] > 0 for w in [*tokens, b""]), n, base, score


@pytest.mark.parametrize("phrase_words, options", [(2, {}), (16, {}), (2, {"shards": 5, "group": 2}), (1, {})])
def test_lm_scores_equal_plain_model(spark, phrase_words, options):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    got = lmscore.score(docs, held_out, phrase_words=phrase_words, bundle_bytes=60, **options).orderBy("doc_id").collect()
    want = list(plain_scores(rows, phrase_words))
    assert any(w[1] for w in want) and [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[5] for w in want])
    assert [r.score for r in got] == pytest.approx([w[6] for w in want], rel=1e-5)


def test_lm_scores_do_not_depend_on_the_bundles(spark):
    """Also where a bundle is read in several parts, cut anywhere."""
    draw = random.Random(3)
    words = ["".join(draw.choices("etaoinshr", k=draw.randint(1, 9))) for _ in range(4000)]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([0, 5, 700, 3000])))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    one, many = (sorted(map(tuple, lmscore.score(docs, F.col("doc_id") % 5 == 0, bundle_bytes=size).collect())) for size in (32 << 20, 300_000))
    assert sum(len(t) for _, t in rows) > 2 << 20
    assert [r[:5] for r in one] == [r[:5] for r in many] and [r[5] for r in one] == pytest.approx([r[5] for r in many])
    assert [r[6] for r in one] == pytest.approx([r[6] for r in many], rel=1e-6)


def test_byte_contexts_sum_to_one_and_cross_words():
    texts = [b"the cat sat on the mat\n", b"the dog sat on the log\n", b"\xc3\xa9t\xc3\xa9 a\x00b\n", b"\n"]
    whole = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
    every = bytecontexts.codes_of(whole, starts, 0, len(whole))
    for size in (1, 5, 7, 20):  # however it is cut
        parts = [bytecontexts.codes_of(whole, starts, i, min(i + size, len(whole))) for i in range(0, len(whole), size)]
        assert np.array_equal(np.concatenate(parts), every)
    codes, counts = np.unique(every, return_counts=True)
    trie = bytecontexts.Trie(codes, counts)
    weights = bytecontexts.escapes(trie.evidence())
    symbols = [b for b in range(256) if b not in (9, 11, 12, 13)]
    for before in (b"\n\n\n\n\n\n", b"sat on", b" on th", b"zzzzzz", b"e cat ", b"\xf0\xf1\xf2\xf3\xf4\xf5"):
        asked = np.array([int.from_bytes(bytes([x]) + before[::-1], "little") for x in symbols])
        assert np.power(10.0, -trie.cost(asked, weights)).sum() == pytest.approx(1)
    plain = PlainContexts(texts)
    for text in (*texts, b"the sat cat on\n", b"qq the\n"):
        got = -trie.cost(bytecontexts.codes_of(np.frombuffer(text, np.uint8), np.zeros(1, int), 0, len(text)), weights)
        assert got == pytest.approx(plain.score(text))
    # The word before matters.
    after = {w: -trie.cost(bytecontexts.codes_of(np.frombuffer(w + b"sat", np.uint8), np.zeros(1, int), 6, 9), weights).sum() for w in (b"e cat ", b" the  ")}
    assert after[b"e cat "] > after[b" the  "] + 0.3


def test_lm_without_training(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    rows = lmscore.score(docs, F.lit(True)).orderBy("doc_id").collect()
    assert [r.train_tokens for r in rows] == [0, 0] and rows[0].base_score == 0
    assert [r.score for r in rows] == pytest.approx([-11 * math.log10(252), -math.log10(252)], rel=1e-6)


def test_lm_beats_unigrams_on_held_out_text(spark):
    """Document by document, not only in the sum."""
    docs = table(spark, f"{DATA}/sf0.1", "documents")
    rows = lmscore.score(docs, id_remainder(F.col("doc_id"), 7) == 2).where("held_out").select("score", "base_score").collect()
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows) > 1000
    assert sum(r.score for r in rows) > 0.85 * sum(r.base_score for r in rows)


def test_a_text_does_not_vouch_for_itself(spark):
    """A training text scores like others of its kind; a copy elsewhere lifts it."""
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ran", "sel", "dop", "vim", "gus")]
    text = lambda n: " ".join(random.Random(n).choices(words, k=60))
    rows = [(n, text(n)) for n in range(40)] + [(100, text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in lmscore.score(docs, F.lit(False)).collect()}
    single = sorted(got[n] for n in range(40) if n != 5)
    assert got[5] == pytest.approx(got[100]) and got[5] > single[-1] + 0.2


def accuracy(scored, truth, on):
    rows = scored.join(truth, "doc_id").where(id_remainder(F.col("doc_id"), 5) == 0).select(on, "told").collect()
    return sum(r[0] == r[1] for r in rows) / len(rows), rows


def test_language_accuracy(spark):
    docs = table(spark, f"{DATA}/sf0.01", "documents")
    tries = langid.fit(docs, id_remainder(F.col("doc_id"), 5) != 0)
    told = langid.identify(docs, tries).select("doc_id", F.col("lang_pred").alias("told"))
    assert accuracy(told, docs.select("doc_id", "lang"), "lang")[0] > 0.98


def labelled(spark, sf, name):
    docs, labels = table(spark, f"{DATA}/{sf}", "documents"), table(spark, f"{DATA}/{sf}", "labels")
    return docs, (docs.where(id_remainder(F.col("doc_id"), 5) != 0), labels), labels.select("doc_id", name)


def test_quality_accuracy(spark):
    docs, train, truth = labelled(spark, "sf0.01", "quality")
    told = quality.score(docs, quality.fit(*train)).select("doc_id", (F.col("score") >= 0.3).cast("int").alias("told"))
    assert accuracy(told, truth, "quality")[0] > 0.95


def test_toxicity_precision_and_recall(spark):
    docs, train, truth = labelled(spark, "sf0.1", "toxic")
    told = toxicity.score(docs, toxicity.fit(*train)).select("doc_id", (F.col("score") >= 0.5).cast("int").alias("told"))
    right, rows = accuracy(told, truth, "toxic")
    hits = sum(r[0] == r[1] == 1 for r in rows)
    assert right > 0.95 and hits > 0.6 * sum(r[0] for r in rows) and hits > 0.95 * sum(r[1] for r in rows)


def test_sample_is_bounded_and_ranked(spark):
    rows = [(i, "x" * (i % 50), "a" if i % 10 else "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid.sample(docs.drop("lang"), docs.drop("text"), "lang", 100, 40)
    counts = {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert counts == {"a": 100, "b": 100} and drawn.agg(F.max(F.length("text"))).first()[0] <= 40

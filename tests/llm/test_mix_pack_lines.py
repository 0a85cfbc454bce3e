"""Mixing, packing and line de-duplication against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldobs.llm import linededup, mixing, packing
from fieldobs.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata"


def plain_mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    of = defaultdict(list)
    for i, _, s in rows:
        of[s].append(i)
    names = sorted((s for s in of if s is not None), key=lambda s: s.encode()) + [s for s in of if s is None]
    total = {s: sum(size[i] for i in of[s]) for s in names}
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    wanted, bound = share * sum(total.values()), {s: most * total[s] for s in names}
    held = set()
    while True:  # share out, hold what is above its bound, share the excess again
        free = [s for s in names if s not in held]
        left = wanted - sum(bound[s] for s in held)
        target = {s: bound[s] if s in held else left * weight[s] / max(sum(weight[f] for f in free), 1e-9) for s in names}
        above = {s for s in free if target[s] > bound[s]}
        if not above:
            break
        held |= above
    taken = {}
    for s in names:
        budget = int(target[s] + 0.5)
        rest = budget - (budget // total[s] if total[s] else 0) * total[s]
        for i in sorted(of[s], key=lambda i: (hashlib.md5(f"mix-{i}".encode()).hexdigest(), size[i])):
            part = min(max(rest, 0), size[i])
            taken[i] = (budget // total[s] * size[i] if total[s] else 0) + part
            rest -= size[i]
    return size, total, target, taken


@pytest.mark.parametrize("bucket_rows", [8192, 16])
def test_mix_equals_plain_version(spark, bucket_rows):
    draw = random.Random(2)
    rows = [(i, " ".join("x" * draw.randint(1, 5) for _ in range(draw.choice([0, 3, 30, 400]))),
             draw.choice(["hot"] * 12 + ["a", "b", "é", "z", None])) for i in range(600)]
    rows += [(1000 + i, "", "empty source") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    size, total, target, taken = plain_mix(rows)
    got = mixing.mix(docs, bucket_rows=bucket_rows, keep=("text",))
    sums = defaultdict(int)
    for r in got.collect():
        assert (r["size"], r.source_size, r.taken) == (size[r.doc_id], total[r.source], taken[r.doc_id])
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r["size"]
        sums[r.source] += r.taken
    assert all(abs(sums[s] - target[s]) <= 0.5 for s in total)
    counts = mixing.copies(got).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    assert {r.doc_id: r.n for r in counts.collect() if r.n} == {i: n for i, n in taken.items() if n}


def test_a_cut_copy_is_a_prefix(spark):
    docs = spark.createDataFrame([(1, " a\tb\nc  d ", "s"), (2, "e f", "t")], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, keep=("text",)).withColumn("epochs", F.lit(1).cast("long")).withColumn("cut", F.lit(2).cast("long"))
    assert sorted(r.text for r in mixing.copies(mixed).collect()) == [" a\tb", " a\tb\nc  d ", "e f", "e f"]


def check_packing(rows, got, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            want[i, piece] = (start, ids[start:start + capacity].tobytes())
    assert {(r.doc_id, r.piece): (r.start, bytes(r.ids)) for r in got} == want
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id] and r.length == len(r.ids) // 4
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= capacity
    return len(fill), sum(fill.values()) / capacity


def test_packing_round_trip(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, f"{DATA}/sf0.01", "documents").select("doc_id", "text").collect()]
    rows += [(5000, "it's they'll x'sy !!'s a.,b. c%%%'d"), (5001, "<|endoftext|>e.g. <|ENDOFTEXT|>"), (5002, None),
             (5003, "ÉTÉ, Straße. ΣΑΣ! İi, ﬁ é. á! 中文, ½½ ²x"), (5004, " a b\x1cc\x85d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    used, least = check_packing(rows, packing.pack(docs, PATH).collect(), 2048)
    assert used <= least * 1.02 + 1


def test_few_open_bins_lose_little(spark):
    docs = table(spark, f"{DATA}/sf0.1", "documents").select("doc_id", "text").coalesce(1)
    sums = packing.pack(docs, PATH, open_bins=64).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert sums[0] <= sums[1] / 2048 * 1.02


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert bins.add("a", 6) is None and bins.add("b", 7) is None
    assert bins.add("c", 5) == ["b"]  # fits nowhere; 3 is less free space than 4
    assert bins.add("d", 4) == ["a", "d"] and bins.count == 1  # the tighter of the two that fit
    assert bins.add("e", 10) == ["e"]
    assert bins.drain() == [["c"]]


def plain_lines(rows):
    first, out = {}, {}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in ordered:
        lines = (text or "").split("\n")
        for p in range(len(lines) - 2):
            window = tuple(lines[p:p + 3])
            if any(x.strip(" ") for x in window):
                first.setdefault(window, (i, p))
    for i, text in ordered:
        lines, gone = (text or "").split("\n"), set()
        for p in range(len(lines) - 2):
            at = first.get(tuple(lines[p:p + 3]))
            if at and at != (i, p):
                gone |= {x for x in range(p, p + 3) if at[0] != i or x >= at[1] + 3}
        out[i] = None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_lines_equal_plain_version(spark):
    draw = random.Random(4)
    passage = [f"passage line {i}" for i in range(6)]
    rows = [(0, None), (1, ""), (2, "\n\n\n\n"), (3, "\n".join(["same"] * 9)), (4, "a\nb\nc\na\nb\nc\nd"), (5, "a\nb\nc\nd\n")]
    for i in range(6, 120):
        lines = [draw.choice(["x", "y", "", "common line", f"own {i} {draw.random()}"]) for _ in range(draw.randint(0, 12))]
        if i % 3 == 0:
            lines[2:2] = passage[draw.randint(0, 2):]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = linededup.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in got} == plain_lines(rows)
    for r in got:
        before = dict(rows)[r.doc_id]
        assert r.n_lines == (0 if before is None else before.count("\n") + 1)
        kept = 0 if before is None or r.n_removed == r.n_lines else r.text.count("\n") + 1
        assert r.n_lines - r.n_removed == kept


def test_lines_plan_is_native(spark):
    plan = linededup.dedup_lines(table(spark, f"{DATA}/sf0.001", "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_crc_of_ids(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    packed = packing.pack(docs, PATH)
    assert packing.digest(packed).first().ids_crc32 == zlib.crc32(bytes(packed.first().ids))


def test_words_alone_equal_the_whole_tokenizer():
    encoder, draw = packing.WordEncoder(PATH), random.Random(8)
    words = ["".join(draw.choice("etaoinshrdluqz") for _ in range(draw.randint(1, 18))).encode() for _ in range(3000)]
    assert encoder.worded and encoder._encode_words(words) == encoder._encode_parts(words)


def test_a_packing_task_holds_few_words_and_texts():
    """350,000 words were kept, and 256 texts of any length cut at once."""
    parts = list(packing.chunks([b"x" * 700_000] * 5 + [b""] * 600))
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 4), (4, 260), (260, 516), (516, 605)]
    assert list(packing.chunks([])) == []
    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for at in range(0, 260_000, 20_000):
        encode([b" ".join(b"%d" % i for i in range(at, at + 20_000))])
    assert len(encode.ids) <= 140_000

"""Scoring documents by prediction by partial matching, trained on the corpus itself.

A text is a sequence of words and one end; its bytes run from word to word (``bytecontexts``). The
trie of byte contexts is path-compressed at one deep anchor:

1. phrases: a run of words up to one that its hash makes a stop word, one in ``phrase_words``, so that the
   words alone decide where it ends. A phrase that training has elsewhere is one symbol: of V distinct ones, seen c
   times of N, it weighs (c - D) / (N - D V), with D = n1 / (n1 + 2 n2) from those seen once and twice. The escape to
   its bytes begins at D V / N and adapts to how often the text at hand has escaped. A training document's own phrases
   are taken out of c, N and V first, so it does not vouch for itself; what it shares with others, it is scored by.
2. bytes: contexts of up to ``ORDER`` bytes over the running text, counted by occurrence in all training
   documents, with estimated escapes and full symbol exclusion. Here a training document's own bytes are in the counts.

All probabilities of texts sum to one at most.

How it runs. Documents are packed into bundles of about ``bundle_bytes`` of text, one compressed
row each, in the shared folder. Every bundle asks for its distinct byte codes, words and phrases only, as numbers
(words and phrases as 64-bit hashes: of a billion words, two may meet): per shard of the keys one row with all of them. One shuffle brings the rows of a
shard together, where their training counts are summed while they stream by, in groups of ``group`` bundles first,
so that no task reads all bundles of a frequent context. Contexts that end in the same two bytes lie in one shard;
only the levels of no and one byte (at most 2**16 counts) and the classes of escapes reach every
task. A second shuffle takes the answers, in the order of the questions, back to the bundles. So nothing that grows
with the corpus is broadcast or collected, and no task holds more than a bundle, or the distinct keys of a shard.

Defined cases: a null or empty text is one end token; repeated rows count and are scored each;
without any training document only the uniform byte model is left; an empty
table gives no rows; other columns are ignored. Only A-Z are lower-cased.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldobs.llm import bytecontexts as bc
from fieldobs.llm.common import blocks_for, lean, staged, text_bytes

CODE, WORD, PHRASE = range(3)
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")
# Keys ascend; counts are those of training documents, 0 for keys only asked for.
KEYS = "kind int, shard int, grp int, bundle long, keys binary, counts binary"
MERGED = "kind int, shard int, keys binary, counts binary, n long, v long, n1 long, n2 long"
ANSWERS = "bundle long, kind int, shard int, answer binary"

def bundles(docs: DataFrame, held_out: Column, bundle_bytes: int) -> DataFrame:
    """(bundle, blob): the documents as compressed Arrow streams of about ``bundle_bytes`` of text."""
    def pack(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in parts:
                out.write_batch(part)
        blob = sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([blob], pa.binary())], ["bundle", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = min(len(ends), int(np.searchsorted(ends, before + bundle_bytes - held)) + 1)
                parts.append(batch.slice(start, stop - start))
                held += int(ends[stop - 1] - before)
                start = stop
                if held >= bundle_bytes:
                    yield pack(parts, number)
                    number, parts, held = number + 1, [], 0
        if parts:
            yield pack(parts, number)

    read = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_bytes().alias("text"))
    return read.mapInArrow(run, "bundle long, blob binary")


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences, behind their number."""
    raw = np.diff(keys, prepend=np.zeros(1, np.int64)).tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked_keys(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.cumsum(np.frombuffer(pa.decompress(blob[8:], 8 * n, "zstd", asbytes=True), np.int64))


def packed_counts(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), "zstd", asbytes=True)


def unpacked_counts(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), "<i8")


_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def multipliers(n: int) -> np.ndarray:
    """The first ``n`` of a fixed row of odd 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(20_240_601)).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def hashed(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each stretch of values: the sum of values times multipliers by place, mixed.

    Two stretches that differ in one value never meet, others once in about 2**56.
    """
    out = np.empty(len(starts), np.uint64)
    sizes = stops - starts
    factor = multipliers(int(sizes.max(initial=0)))
    totals = np.cumsum(sizes)
    at = 0
    while at < len(starts):
        upto = max(int(np.searchsorted(totals, totals[at] - sizes[at] + most)), at + 1)
        size = sizes[at:upto]
        begins = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begins, size)
        part = values[np.repeat(starts[at:upto], size) + place].astype(np.uint64) + np.uint64(1)
        out[at:upto] = np.add.reduceat(part * factor[place], begins)
        at = upto
    out += sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift in (33, 29):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ out >> np.uint64(32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    text = np.frombuffer(b"".join(words), np.uint8)
    stops = np.cumsum([len(w) for w in words], dtype=np.int64)
    return hashed(text, stops - np.array([len(w) for w in words], np.int64), stops)


#: The token behind the last word. No word has its hash but by chance.
END = np.uint64(0x1D8E4E27C47D124F)


class Bundle:
    """One bundle's documents as flat arrays: bytes in context, tokens, phrases.

    A token is a word, or the end of a text. ``tokens`` and ``phrases`` are hashes; ``doc_tokens``, ``doc_phrases`` and
    ``doc_bytes`` tell where each document begins, ``phrase_bytes`` where the bytes of each phrase do.
    """

    def __init__(self, blob: bytes, phrase_words: int, block: int = 4 << 20):
        table = pa.ipc.open_stream(blob).read_all()
        self.doc_ids = table.column("doc_id").to_pandas(types_mapper=pd.ArrowDtype)
        self.held_out = np.array(table.column("held_out").to_pylist(), bool)
        texts = table.column("text")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        names = ("text", "tokens", "phrases", "doc_bytes", "doc_tokens", "doc_phrases", "phrase_bytes")
        parts: dict[str, list[np.ndarray]] = {name: [] for name in names}
        at = 0
        while at < len(upto):  # a block of documents at a time
            stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + block)), at + 1)
            whole = {"doc_bytes": "text", "doc_tokens": "tokens", "doc_phrases": "phrases", "phrase_bytes": "text"}
            read = dict(zip(names, self._read(texts.slice(at, stop - at).to_pylist(), phrase_words)))
            for name, other in whole.items():
                parts[name].append(read[name] + sum(len(x) for x in parts[other]))
            for name in names[:3]:
                parts[name].append(read[name])
            at = stop
        for name in names:
            setattr(self, name, np.concatenate(parts.pop(name)))

    @staticmethod
    def _read(texts: list[bytes], phrase_words: int) -> tuple[np.ndarray, ...]:
        last = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        # A line feed behind each text.
        raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        word = ~_SPACES[raw]
        edge = np.flatnonzero(np.diff(word, prepend=False))
        starts, stops = edge[::2], edge[1::2]  # a word ends before some space, at the latest that line feed
        hashes = hashed(raw, starts, stops)
        upto = np.searchsorted(starts, last)  # words up to the end of each document
        n_words = np.diff(upto, prepend=0)

        # Words with one space between them, and a line feed at the end.
        word[stops] = True
        text = raw.copy()
        text[stops] = 0x20
        full = n_words > 0
        text[stops[upto[full] - 1]] = bc.END
        word[last[~full]] = True
        text = text[word]
        behind = np.cumsum(stops - starts + 1)  # each word with the byte behind it
        ends = np.append(0, behind)[upto] + np.cumsum(~full)
        behind += np.repeat(np.cumsum(~full), n_words)  # and the texts of an end alone before it

        # Tokens: every document's words and its end.
        doc_tokens = np.cumsum(n_words + 1) - n_words - 1
        is_end = np.zeros(len(hashes) + len(last), bool)
        is_end[doc_tokens + n_words] = True
        tokens = np.empty(len(is_end), np.uint64)
        tokens[is_end], tokens[~is_end] = END, hashes
        byte = np.empty(len(is_end), np.int64)  # where the bytes of the next token begin
        byte[is_end], byte[~is_end] = ends, behind
        byte[np.flatnonzero(is_end)[full] - 1] -= 1  # the line feed is the end's
        # Phrases begin with a document and behind each stop word.
        begins = np.zeros(len(is_end), bool)
        begins[doc_tokens] = True
        begins[1:] |= stop_words(tokens[:-1], phrase_words) & ~is_end[:-1]
        first = np.flatnonzero(begins)
        phrases = hashed(tokens, first, np.append(first[1:], len(begins))).view(np.int64)
        return (text, tokens.view(np.int64), phrases, np.append(0, ends[:-1]), doc_tokens,
                np.searchsorted(first, doc_tokens), np.append(0, byte[first[1:] - 1]))

    def per_document(self, starts: np.ndarray, total: int) -> np.ndarray:
        return np.diff(np.append(starts, total))

    def code_parts(self, size: int = 2 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Where each stretch of the text begins, and its codes."""
        for begin in range(0, len(self.text), size):
            yield begin, bc.codes_of(self.text, self.doc_bytes, begin, min(begin + size, len(self.text)))

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of a kind in order, with their occurrences in training documents."""
        if kind == CODE:
            trained = np.repeat(~self.held_out, self.per_document(self.doc_bytes, len(self.text)))
            total = _Sum()
            for begin, codes in self.code_parts():
                own = trained[begin:begin + len(codes)]
                other = _distinct(codes[~own])[0]
                total.add(other, np.zeros(len(other), np.int64))
                total.add(*_distinct(codes[own]))
            return total.result()
        keys, starts = (self.tokens, self.doc_tokens) if kind == WORD else (self.phrases, self.doc_phrases)
        return bc.summed(keys, np.repeat(~self.held_out, self.per_document(starts, len(keys))).astype(np.int64))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their occurrences, sorting in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def stop_words(tokens: np.ndarray, phrase_words: int) -> np.ndarray:
    """Whether a phrase ends with each of these words."""
    return (tokens >> np.uint64(40)) % np.uint64(phrase_words) == 0


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    return bc.shard_of(keys, shards) if kind == CODE else (keys >> 7) % shards


def by_shard(kind: int, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys together by shard, and where each shard begins in it."""
    own = shard_of(kind, keys, shards)
    return np.argsort(own, kind="stable"), np.searchsorted(np.sort(own), np.arange(shards + 1))


def asked(packed: DataFrame, phrase_words: int, shards: int, group: int) -> DataFrame:
    """Each bundle's distinct keys by kind and shard, with its own training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("bundle").to_pylist(), batch.column("blob")):
                bundle = Bundle(blob.as_buffer(), phrase_words)
                for kind in (CODE, WORD, PHRASE):
                    keys, counts = bundle.keys(kind)
                    order, begins = by_shard(kind, keys, shards)
                    rows = []
                    for shard in range(shards):
                        at = order[begins[shard]:begins[shard + 1]]
                        if len(at):
                            rows.append((kind, shard, zlib.crc32(str(number).encode()) % max(group, 1), number,
                                         packed_keys(keys[at]), packed_counts(counts[at])))
                    yield _rows(rows, KEYS)

    return packed.mapInArrow(lean(run), KEYS)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


class _Sum:
    """Counts by key, summed while they stream by."""

    def __init__(self, most: int = 1_000_000):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.most = 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.most + len(self.keys[0]):
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts = [], []  # let go before sorting
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = counts[order]
        del order
        keys, counts = bc.runs_of(keys, counts)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return keys, counts


def merged(rows: DataFrame, by: list[str], partitions: int) -> DataFrame:
    """One row per kind, shard (and group) with all keys that occur in training, and their figures."""
    schema = KEYS + ", n long, v long, n1 long, n2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, _Sum()

        def close() -> pa.RecordBatch:
            keys, counts = total.result()
            keys, counts = keys[counts > 0], counts[counts > 0]
            return _rows([(*now, -1, packed_keys(keys), packed_counts(counts), int(counts.sum()), len(keys),
                           int((counts == 1).sum()), int((counts == 2).sum()))], schema)

        for batch in batches:
            for kind, shard, grp, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("kind", "shard", "grp", "keys", "counts")]):
                if now != (kind, shard, grp):
                    if now is not None:
                        yield close()
                    now, total = (kind, shard, grp), _Sum()
                keys = unpacked_keys(keys)
                total.add(keys, unpacked_counts(counts, len(keys)))
        if now is not None:
            yield close()

    if "grp" not in by:
        rows = rows.withColumn("grp", F.lit(0))
    together = rows.repartition(partitions, *by).sortWithinPartitions("kind", "shard", "grp")
    return together.select("kind", "shard", "grp", "bundle", "keys", "counts").mapInArrow(lean(run), schema)


def evidence(tables: DataFrame) -> tuple[list, tuple[np.ndarray, np.ndarray]]:
    """What escapes are estimated from, by level, and the counts of byte pairs: both of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys = unpacked_keys(keys)
                counts = unpacked_counts(counts, len(keys))
                rows = [(-1, int(k), float(n), 0.0) for k, n in zip(*bc.pairs(keys, counts))]
                for level, (novel, seen) in enumerate(bc.Trie(keys, counts).evidence()):
                    if level > 1:  # shorter contexts are not whole in a shard
                        rows += [(level, int(c), float(novel[c]), float(seen[c])) for c in np.flatnonzero(novel + seen)]
                yield _rows(rows, schema)

    schema = "level int, class long, novel double, seen double"
    sums = tables.where(F.col("kind") == CODE).select("keys", "counts").mapInArrow(lean(run), schema).groupBy("level", "class").agg(
        F.sum("novel").alias("novel"), F.sum("seen").alias("seen")).orderBy("level", "class").toArrow().to_pandas()
    pair = sums[sums["level"] == -1]
    low = pair["class"].to_numpy(np.int64), pair["novel"].to_numpy()
    found = bc.Trie(np.empty(0, np.int64), np.empty(0), low=low).evidence()
    for level in range(2, bc.ORDER + 1):
        part, (novel, seen) = sums[sums["level"] == level], found[level]
        novel[part["class"]], seen[part["class"]] = part["novel"], part["seen"]
    return found, low


def answered(keys: DataFrame, tables: DataFrame, told: list, low: tuple, groups: int, partitions: int) -> DataFrame:
    """Per bundle, kind and shard the answers to its keys in their order: log10 costs of codes, counts of others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = bc.escapes(told)
        table, values, trie = np.empty(0, np.int64), np.empty(0), None
        now = None
        for batch in batches:
            rows = []
            for kind, shard, grp, bundle, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("kind", "shard", "grp", "bundle", "keys", "counts")]):
                keys = unpacked_keys(keys)
                if now != (kind, shard, grp):  # the table comes first, if training has any key of the shard
                    now, table, values = (kind, shard, grp), np.empty(0, np.int64), np.empty(0)
                    mine = bundle == -1
                    if mine:
                        table, values = keys, unpacked_counts(counts, len(keys)).astype(float)
                    if kind == CODE:
                        trie = bc.Trie(table, values, low=low)
                        values = trie.cost(table, weights)
                    if mine:
                        continue
                at, there = bc._at(table, keys)
                answer = np.where(there, values[at], 0.0) if len(table) else np.zeros(len(keys))
                if kind == CODE and not there.all():
                    answer[~there] = trie.cost(keys[~there], weights)
                form = "<f4" if kind == CODE else "<f8"
                rows.append((bundle, kind, shard, pa.compress(answer.astype(form).tobytes(), "zstd", asbytes=True)))
            yield _rows(rows, ANSWERS)

    every = tables.drop("grp").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = ["kind", "shard", "grp", "bundle", "keys", "counts"]
    together = keys.select(*columns).unionByName(every.select(*columns)).repartition(partitions, "kind", "shard", "grp")
    return together.sortWithinPartitions("kind", "shard", "grp", "bundle").mapInArrow(lean(run), ANSWERS)


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def phrase_logs(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray, trained: np.ndarray, figures: dict,
                prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """log10 weights of documents' phrases in turn, and which of them escape to their bytes; each without its own document.

    ``starts`` tells where each document begins, ``trained`` which ones are in the counts. A text's first escape is
    weighed by the corpus, which counts for ``prior`` phrases of the text.
    """
    d = _discount(figures["n1"], figures["n2"])
    sizes = np.diff(np.append(starts, len(keys)))
    doc = np.repeat(np.arange(len(starts)), sizes)
    order = np.lexsort((keys, doc))
    fresh = np.append(True, (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[:len(keys)]
    heads = np.flatnonzero(fresh)
    mine = np.empty(len(keys))
    mine[order] = np.repeat(np.diff(np.append(heads, len(keys))), np.diff(np.append(heads, len(keys))))
    others = counts - np.where(trained[doc], mine, 0)
    lost = np.zeros(len(keys))
    lost[order[heads]] = others[order[heads]] <= 0
    n = figures["n"] - np.where(trained, sizes, 0)
    v = figures["v"] - np.where(trained, np.add.reduceat(lost, starts), 0)
    unknown = others <= 0
    before = np.arange(len(keys)) - np.repeat(starts, sizes)
    escaped = np.cumsum(unknown) - unknown
    escaped -= np.repeat(escaped[starts], sizes)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = (escaped + prior * (d * v / n)[doc]) / (before + prior)
        known = (1 - escape) * (others - d) / (n - d * v)[doc]
        return np.where(n[doc] > 0, np.log10(np.where(unknown, escape, known)), 0.0), unknown


def score(docs: DataFrame, held_out: Column, phrase_words: int = 32, bundle_bytes: int = 32 << 20,
          shards: int | None = None, group: int = 1024) -> DataFrame:
    """Score every document of ``docs`` (doc_id, text), learning from those not ``held_out``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and
    score, both log10 probabilities of the whole text. ``shards`` (by default one for 64 MB of text, 32 to 4096) and
    ``group`` settle how the work is cut, not the result.
    """
    packed = staged(bundles(docs, held_out, bundle_bytes), "lm-bundles")
    size = packed.agg(F.count("*").alias("n")).first()["n"]
    groups = blocks_for(size, group)
    shards = shards or min(max(blocks_for(size * bundle_bytes, 64 << 20), 32), 4096)
    partitions = 2 * shards
    keys = staged(asked(packed, phrase_words, shards, groups), "lm-keys")
    parts = merged(keys, ["kind", "shard", "grp"], partitions)
    tables = staged(merged(parts.drop("n", "v", "n1", "n2"), ["kind", "shard"], partitions), "lm-tables")
    figures = {r["kind"]: r.asDict() for r in tables.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).collect()}
    none = {"n": 0, "v": 0, "n1": 0, "n2": 0}
    word, phrase = figures.get(WORD, none), figures.get(PHRASE, none)
    told, low = evidence(tables)
    back = answered(keys, tables, told, low, groups, partitions)

    def tell(blob: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        bundle = Bundle(blob["blob"].iloc[0], phrase_words)
        of = {(k, s): a for k, s, a in zip(answers["kind"], answers["shard"], answers["answer"])}

        def values(kind: int, keys: np.ndarray, form: str) -> np.ndarray:
            """Answers to distinct keys, as they were asked for by shard."""
            order, begins = by_shard(kind, keys, shards)
            out = np.empty(len(keys), form)
            for shard in range(shards):
                at = order[begins[shard]:begins[shard + 1]]
                if len(at):
                    out[at] = np.frombuffer(pa.decompress(of.pop((kind, shard)), len(at) * out.itemsize, "zstd", asbytes=True), form)
            return out

        keys, _ = bundle.keys(CODE)
        costs = values(CODE, keys, "<f4")
        spent = np.zeros(len(bundle.phrases))
        for begin, codes in bundle.code_parts():
            order = np.argsort(codes)
            part = np.empty(len(codes))
            part[order] = costs[np.searchsorted(keys, codes[order])]
            first = np.searchsorted(bundle.phrase_bytes, begin, "right")  # the phrase before it goes on here
            after = np.searchsorted(bundle.phrase_bytes, begin + len(codes))
            spent[first - 1:after] += np.add.reduceat(part, np.append(0, bundle.phrase_bytes[first:after] - begin))
        del keys, costs
        words, where = np.unique(bundle.tokens, return_inverse=True)
        counts = values(WORD, words, "<f8")[where]
        phrases, where = np.unique(bundle.phrases, return_inverse=True)
        logs, spelt = phrase_logs(bundle.phrases, values(PHRASE, phrases, "<f8")[where], bundle.doc_phrases, ~bundle.held_out, phrase)
        logs = logs - np.where(spelt, spent, 0.0)
        base = np.log10((counts + 1) / (word["n"] + word["v"] + 1))
        return pd.DataFrame({
            "doc_id": bundle.doc_ids.astype("Int64").to_numpy(), "held_out": bundle.held_out,
            "n_tokens": bundle.per_document(bundle.doc_tokens, len(bundle.tokens)),
            "n_known": np.add.reduceat((counts > 0).astype(np.int64), bundle.doc_tokens), "train_tokens": word["n"],
            "base_score": np.add.reduceat(base, bundle.doc_tokens), "score": np.add.reduceat(logs, bundle.doc_phrases)})

    return packed.groupBy("bundle").cogroup(back.groupBy("bundle")).applyInPandas(tell, SCORES)

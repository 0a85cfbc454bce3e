"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of words with smallest period q (words q apart are the same), at least
twice as long as q, that no neighbouring word extends. All runs of a document are found by
descending-LCP Kruskal: neighbours in its suffix array are the edges of a path, weighted by
their longest common prefix. Edges are taken by decreasing weight; each unites two classes of
suffixes in a union-find whose classes keep their positions in order, the smaller class moved
into the larger. Two positions that become neighbours in a class at weight w share exactly w
words, so if they lie q <= w apart, a stretch of period q and length q + w begins at the first.
It is a run unless the word before continues it. Conversely the first two periods of any run
become neighbours at the weight that gives its length; a position between them would give the
run a smaller period. Weights below half the least length seed nothing, so edges under it
are never taken, and positions that share too few words with any other are never sorted out.

Documents are independent: one map, no shuffle. For n words a task needs some integers per
word and per doubling step of the suffix sort, O(n log n) time for sorting and moving positions.

Defined cases: a null or empty text has no words and no run. Words are bytes between ASCII
white space. Repeated rows are treated alike; an empty table gives no rows; other columns pass
through, but for ``runs`` and ``collapsed``, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldobs.llm.common import WORD, map_texts, text_bytes

RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ARROW_RUN = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


class Positions:
    """An ordered set of positions in chunks, so that adding one moves few others."""

    CHUNK = 1024

    def __init__(self, position: int):
        self.chunks = [[position]]
        self.firsts = [position]
        self.size = 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def around(self, position: int) -> tuple[int | None, int | None]:
        """The nearest members before and behind a position that is no member."""
        k = max(bisect_left(self.firsts, position) - 1, 0)
        chunk = self.chunks[k]
        i = bisect_left(chunk, position)
        before = chunk[i - 1] if i else None
        if i < len(chunk):
            return before, chunk[i]
        return before, self.firsts[k + 1] if k + 1 < len(self.firsts) else None

    def behind(self, position: int) -> int | None:
        """The nearest member behind a member."""
        return self.around(position + 0.5)[1]

    def add(self, position: int) -> None:
        k = max(bisect_left(self.firsts, position) - 1, 0)
        chunk = self.chunks[k]
        insort(chunk, position)
        self.firsts[k] = chunk[0]
        self.size += 1
        if len(chunk) > 2 * self.CHUNK:
            self.chunks[k:k + 1] = [chunk[:self.CHUNK], chunk[self.CHUNK:]]
            self.firsts[k:k + 1] = [chunk[0], chunk[self.CHUNK]]


class Classes:
    """Union-find over suffixes; every class keeps its positions in order."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.members: dict[int, Positions] = {}

    def root(self, p: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(p, p)) != p:
            parent[p] = p = parent[up]
        return p

    def of(self, root: int) -> Positions:
        if root not in self.members:
            self.members[root] = Positions(root)
        return self.members[root]

    def unite(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Unite the classes of two suffixes; yields the pairs that are neighbours only now."""
        a, b = self.root(a), self.root(b)
        if self.of(a).size < self.of(b).size:
            a, b = b, a
        large, small = self.of(a), list(self.members.pop(b))
        self.parent[b] = a
        last = None
        for i, p in enumerate(small):
            before, behind = large.around(p)
            if before is not None and (last is None or before > last):
                yield before, p
            if behind is not None and (i + 1 == len(small) or behind < small[i + 1]):
                yield p, behind
            last = p
        for p in small:
            large.add(p)


def _ranks(words: np.ndarray, least: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of the sequences of 1, 2, 4, … words from each position, and the positions that share ``least`` words.

    A sequence that ends with the text ranks before longer ones. Doubling goes on for the
    positions still tied, until none is.
    """
    def doubled(rank: np.ndarray, step: int, at: np.ndarray) -> np.ndarray:
        """Ranks of twice the step, refined at ``at``, where positions are tied."""
        beyond = np.zeros(len(at), np.int64)
        inside = at + step < n
        beyond[inside] = rank[at[inside] + step] + 1
        key = rank[at].astype(np.int64) * (n + 1) + beyond
        order = np.argsort(key, kind="stable")
        key = key[order]
        group = rank[at][order]
        fresh = np.append(True, key[1:] != key[:-1])
        first = np.append(True, group[1:] != group[:-1])
        # A class keeps the rank it has; its parts follow it by the number of positions before them.
        place = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(first, place, 0))
        part = np.maximum.accumulate(np.where(fresh, place, 0))
        out = rank.copy()
        out[at[order]] = group + part - begin
        return out

    def tied(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at[np.bincount(rank[at], minlength=n)[rank[at]] > 1]

    n = len(words)
    # The rank of a class is the number of positions in lower classes.
    counts = np.bincount(words)
    rank = (np.cumsum(counts) - counts)[words].astype(np.int32)
    levels, step, at = [(1, rank)], 1, np.arange(n)
    shared = at = tied(rank, at)
    while len(at):
        rank = doubled(rank, step, at)
        step *= 2
        at = tied(rank, at)
        if step <= least:
            shared = at
        if len(at):
            levels.append((step, rank))
    levels.append((0, rank))
    return levels, shared


def find(words: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``least`` words, by start and period.

    ``words`` are the words' numbers from 0 on.
    """
    n, low = len(words), (least + 1) // 2
    if n < max(least, 2):
        return []
    levels, shared = _ranks(words, low)
    order = shared[np.argsort(levels[-1][1][shared], kind="stable")]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for step, rank in reversed(levels[:-1]):
        inside = (a + common + step <= n) & (b + common + step <= n)
        x, y = (a + common)[inside], (b + common)[inside]
        common[inside] += step * (rank[x] == rank[y])
    edges = np.argsort(-common, kind="stable")
    edges = edges[common[edges] >= low]

    classes, found = Classes(), []
    plain = words.tolist()
    seeds, level = [], None

    def close() -> None:
        for p, q in seeds:  # neighbours still, now that all edges of the level are taken?
            if classes.of(classes.root(p)).behind(p) == q:
                found.append((p, q - p + level, q - p))
        seeds.clear()

    for w, x, y in zip(common[edges].tolist(), a[edges].tolist(), b[edges].tolist()):
        if w != level:
            close()
            level = w
        for p, q in classes.unite(x, y):
            if q - p <= w and q - p + w >= least and (p == 0 or plain[p - 1] != plain[q - 1]):
                seeds.append((p, q))
    close()
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of the word it first is."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def repeated(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which words some run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with the runs of each text (array of start, length, period; by start, then period) and
    ``collapsed``: the words that no run contains after its first period, joined by one space."""
    keep = [c for c in docs.columns if c not in ("runs", "collapsed")]
    read = docs.select(*keep, text_bytes().alias("__bytes"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("runs", RUN),
                           T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = [], []
            for text in batch.column("__bytes"):
                words = text.as_py().split()
                found = find(numbered(words), least)
                if found:
                    gone = repeated(found, len(words))
                    words = [w for w, out in zip(words, gone.tolist()) if not out]
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(runs, _ARROW_RUN), pa.array(collapsed, pa.binary()).cast(pa.string())],
                [*keep, "runs", "collapsed"])

    return map_texts(read, run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text), one in ten with a text that turns periodic.

    With h the crc32 of the id (a null one counts as empty) and g = h div 10, the texts with h mod 10 = 0 repeat from word
    a = g mod n on the p = 1 + (n - a) div (3 + g mod 8) words found there. Their words are
    then joined by one space.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    row = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    row = row.withColumn("g", F.expr("h div 10"))
    # Only where the text changes is it cut into words here.
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    row = row.withColumn("words", words).withColumn("n", F.size("words"))
    row = row.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    row = row.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    kept = F.slice("words", F.lit(1), F.col("a").cast("int"))
    block = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    left = F.col("n") - F.col("a")
    whole = F.flatten(F.array_repeat(block, F.expr("(n - a + p - 1) div p").cast("int")))
    text = F.array_join(F.concat(kept, F.slice(whole, F.lit(1), left.cast("int"))), " ")
    return row.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def digest(collapsed: DataFrame) -> DataFrame:
    """Per document: how many runs, the longest one, and hashes of all runs and of the collapsed text."""
    order = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    top = F.array_max(order)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return collapsed.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-top["s"]).alias("start"), top["length"].alias("length"),
        (-top["p"]).alias("period"), F.floor(1000 * top["length"] / -top["p"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

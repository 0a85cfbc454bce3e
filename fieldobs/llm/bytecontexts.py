"""Byte contexts over running text: a trie with estimated escapes and symbol exclusion.

The trie is kept by levels as sorted arrays. A code is a byte in its context of ``ORDER`` bytes as one
number: the byte itself lowest, the one before it next, and so on; the low bytes of a code are
the same byte in a shorter context. A text is its words with one space between them and a line
feed as its end, and begins after line feeds; contexts run over spaces from word to word.

A byte is sought in its longest known context and, after an escape, in the next shorter one, down
to a uniform choice of what is left of the alphabet. What has followed a longer context is
excluded from the shorter ones, and so are its occurrences there: the longest contexts count
occurrences, a shorter one in how many different contexts a byte longer each byte followed it
(update exclusion). The weight of an escape is estimated from the counts themselves,
by leaving one count out at a time: among contexts of one level with ``t`` counts
of ``s`` different bytes, how often is one more a new byte?
"""

from __future__ import annotations

import numpy as np

ORDER = 6
END = 0x0A
#: Bytes a text may hold (all but six of white space), the space and the end.
ALPHABET = 256 - 6 + 2
_T, _S = 200, 64
CLASSES = _T * _S


def codes_of(text: np.ndarray, starts: np.ndarray, begin: int, end: int, order: int = ORDER) -> np.ndarray:
    """The codes of the bytes from ``begin`` to ``end`` of texts that lie one behind the other from ``starts`` on.

    No context reaches into the text before: line feeds stand there.
    """
    from_byte = max(begin - 7, 0)
    held = np.concatenate([np.zeros(7 - (begin - from_byte), np.uint8), text[from_byte:end]])
    eight = np.ndarray((end - begin,), ">u8", held, 0, (1,))
    codes = eight.astype(np.int64)
    codes &= (1 << 8 * (order + 1)) - 1
    near = starts[np.searchsorted(starts, begin - order):np.searchsorted(starts, end)]
    stops = np.append(starts, len(text))[np.searchsorted(starts, near, "right")]
    for reach in range(order):  # bytes of its own text before this one
        at = near[near + reach < stops] + reach
        at = at[(at >= begin) & (at < end)] - begin
        fed = sum(END << 8 * back for back in range(reach + 1, order + 1))
        codes[at] = codes[at] & ((1 << 8 * (reach + 1)) - 1) | fed
    return codes


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """Codes whose contexts end in the same two bytes lie in one shard."""
    return (((codes >> 8) & 0xFFFF) * 0x9E3779B1 >> 12) % shards


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    return runs_of(keys[order], counts[order])


def runs_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``summed`` of keys in order."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _shorter(keys: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys a context byte shorter, with the number of different keys each comes from."""
    return summed(keys & ((1 << 8 * n_bytes) - 1), np.ones(len(keys)))


def pairs(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level 1 of the trie: each byte behind the one before it, 2**16 at most. Its counts add up over shards."""
    return _shorter(np.unique(codes[counts > 0] & 0xFFFFFF), 2)


def _class(t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Contexts alike in occurrences and different bytes; by octave beyond some."""
    tall = np.where(t <= 24, t, 24 + np.ceil(4 * np.log2(np.maximum(t, 1) / 24)))
    wide = np.where(s <= 6, s, 6 + np.ceil(2 * np.log2(np.maximum(s, 1) / 6)))
    return (np.minimum(tall, _T - 1) * _S + np.minimum(wide, _S - 1)).astype(np.int64)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Level:
    """The bytes seen in every context of one length; ``below`` is the next shorter level."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: Level | None, n_bytes: int):
        self.keys, self.counts = keys, counts.astype(float)
        first = np.flatnonzero(np.append(True, keys[1:] >> 8 != keys[:-1] >> 8)[:len(keys)])
        self.contexts = keys[first] >> 8
        self.totals = np.add.reduceat(self.counts, first) if len(first) else self.counts
        self.kinds = np.diff(np.append(first, len(keys))).astype(float)
        self.singles = np.add.reduceat((self.counts == 1).astype(float), first) if len(first) else self.counts
        # The shorter context's count of all that has followed this one: what an escape excludes there.
        self.excluded = np.zeros(len(first))
        if below is not None and len(first):
            spot, there = _at(below.keys, keys & ((1 << 8 * n_bytes) - 1))
            self.excluded = np.add.reduceat(np.where(there, below.counts[spot], 0.0), first)

    def evidence(self) -> tuple[np.ndarray, np.ndarray]:
        """By class: counts that, left out, would be a new byte in their context; and those that would not."""
        novel, seen = np.zeros(CLASSES), np.zeros(CLASSES)
        more = self.totals > 1
        t, s, singles = self.totals[more], self.kinds[more], self.singles[more]
        np.add.at(novel, _class(t - 1, s - 1), singles)
        np.add.at(seen, _class(t - 1, s), t - singles)
        return novel, seen


class Trie:
    """Levels from codes with counts; ``low`` is level 1 of a trie that holds only a part of the deeper levels."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER,
                 low: tuple[np.ndarray, np.ndarray] | None = None):
        self.order = order
        held = [summed(codes[counts > 0], counts[counts > 0])]
        for level in range(order - 1, -1, -1):
            held.insert(0, low if level == 1 and low is not None else _shorter(held[0][0], level + 1))
        self.levels: list[Level] = []
        for level, (keys, n) in enumerate(held):
            self.levels.append(Level(keys, n, self.levels[-1] if level else None, level))

    def evidence(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [level.evidence() for level in self.levels]

    def cost(self, codes: np.ndarray, escapes: list[np.ndarray]) -> np.ndarray:
        """log10 probability, negated, of each code's byte in its context; ``escapes`` by level and class."""
        logs, out, known = np.zeros(len(codes)), np.zeros(len(codes)), np.zeros(len(codes))
        todo = np.arange(len(codes))
        for n, level, escape in zip(range(self.order, -1, -1), self.levels[::-1], escapes[::-1]):
            if not len(level.keys):
                continue
            mine = codes[todo] & ((1 << 8 * (n + 1)) - 1)
            at, there = _at(level.contexts, mine >> 8)
            here, at, mine = todo[there], at[there], mine[there]
            left = level.totals[at] - out[here]
            leave = escape[_class(level.totals[at], level.kinds[at])]
            spot, hit = _at(level.keys, mine)
            logs[here[hit]] -= np.log10((1 - leave[hit]) * level.counts[spot[hit]] / left[hit])
            gone = ~hit & (left > 0)  # where all is excluded, there is nothing to leave
            logs[here[gone]] -= np.log10(leave[gone])
            out[here], known[here] = level.excluded[at], level.kinds[at]
            over = np.zeros(len(codes), bool)
            over[here[hit]] = True
            todo = todo[~over[todo]]
        logs[todo] += np.log10(np.maximum(ALPHABET - known[todo], 1))
        return logs


def escapes(evidence: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The weight of an escape by level and class, a half added to either side."""
    return [(novel + 0.5) / (novel + seen + 1) for novel, seen in evidence]

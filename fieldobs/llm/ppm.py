"""Prediction by partial matching over the bytes of words.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of what followed
them. A word is coded byte by byte and closed by a white-space byte, which no word contains;
contexts begin at the space before the word and do not reach into the word before it. So the
cost of a word depends on the word alone and is worked out once per distinct word.

A byte is sought in its longest known context and, after an escape, in the next shorter one,
down to a uniform choice of what is left of the alphabet. Escapes are estimated by method D
(each novel successor is worth half a count). Symbols are excluded fully: whatever follows a
context has also followed its suffixes, so the counts an escape rules out in the shorter
context are a sum that can be kept with the longer one.

Contexts are numbers: the byte to come is the lowest byte, the one before it the next, and so
on. A context that reaches the start of its word ends there with the space.
"""

from __future__ import annotations

import numpy as np

ORDER = 6
SPACE = 0x20
#: Bytes a word may hold (all but six of white space) and the one that ends it.
ALPHABET = 256 - 6 + 1


def word_codes(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every byte of the words, each closed by a space, and where each word starts.

    Codes of an order of up to 6 are signed, as Spark's longs are; one of 7 fills all 64 bits.
    """
    kind = np.int64 if order < 7 else np.uint64
    if not words:
        return np.empty(0, kind), np.empty(0, np.int64)
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    at = np.arange(1, len(text))
    spaces = np.flatnonzero(text == SPACE)
    lengths = np.diff(spaces)
    reach = at - np.repeat(spaces[:-1], lengths)  # bytes back to the space before the word
    wide = text.astype(kind)
    codes = wide[1:].copy()
    for back in range(1, order + 1):
        inside = reach >= back
        codes[inside] |= wide[at[inside] - back] << (8 * back)
    return codes, spaces[:-1]


def context_length(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Bytes of context in each code; only one that begins a word is shorter than ``order``."""
    length = np.full(len(codes), order, np.int8)
    for back in range(order, 0, -1):
        length[(codes >> (8 * back)) & 0xFF == SPACE] = back
    return length


def _low(codes: np.ndarray, n_bytes: int) -> np.ndarray:
    return codes & ((1 << (8 * n_bytes)) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the wanted values in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def pairs_of(codes: np.ndarray, counts: np.ndarray, length: np.ndarray, level: int):
    """Distinct (context, byte) of one level with their counts; counts of zero are no occurrence."""
    own = (length >= level) & (counts > 0)
    keys, inverse = np.unique(_low(codes[own], level + 1), return_inverse=True)
    return keys, np.bincount(inverse, counts[own], len(keys))


class Trie:
    """Counts by context; ``low`` gives the levels 0 and 1 of a trie that holds only a part of the deeper ones."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER,
                 low: tuple[np.ndarray, np.ndarray] | None = None):
        self.order, self.levels = order, []
        length = context_length(codes, order)
        below: tuple[np.ndarray, np.ndarray] | None = None
        for level in range(order + 1):
            if low is not None and level < 2:
                source, n = low
                keys, c = pairs_of(source, n, np.ones(len(source), np.int8), level)
            else:
                keys, c = pairs_of(codes, counts, length, level)
            contexts, first, successors = np.unique(keys >> 8, return_index=True, return_counts=True)
            totals = np.add.reduceat(c, first) if len(first) else np.empty(0)
            ruled_out = np.zeros(len(contexts))
            if below is not None and len(keys):
                at, there = _find(below[0], _low(keys, level))
                ruled_out = np.add.reduceat(np.where(there, below[1][at], 0.0), first)
            self.levels.append((keys, c, contexts, totals, successors, ruled_out))
            below = keys, c

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """log2 probability, negated, of each code's byte in its context."""
        length = context_length(codes, self.order)
        bits = np.zeros(len(codes))
        ruled_out, known = np.zeros(len(codes)), np.zeros(len(codes))
        todo = np.arange(len(codes))
        for level in range(self.order, -1, -1):
            keys, c, contexts, totals, successors, excluded = self.levels[level]
            if not len(keys):
                continue
            # A code whose context is shorter than the level waits for its own level.
            own = length[todo] >= level
            here = todo[own]
            at, there = _find(contexts, _low(codes[here], level + 1) >> 8)
            here, at = here[there], at[there]
            total = totals[at] - ruled_out[here]
            novel = successors[at] - known[here]
            spot, hit = _find(keys, _low(codes[here], level + 1))
            bits[here[hit]] -= np.log2((c[spot[hit]] - 0.5) / total[hit])
            miss = ~hit & (total > 0)
            bits[here[miss]] -= np.log2(0.5 * novel[miss] / total[miss])
            ruled_out[here], known[here] = excluded[at], successors[at]
            done = np.zeros(len(codes), bool)
            done[here[hit]] = True
            todo = todo[~done[todo]]
        left = np.maximum(ALPHABET - known[todo], 1)
        bits[todo] += np.log2(left)
        return bits

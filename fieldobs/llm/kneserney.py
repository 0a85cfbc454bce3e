"""Class-conditional Kneser-Ney models over the bytes of words.

Two models, one per class, predict each byte of a word from up to ``order`` bytes before it
(contexts begin at the space before the word, as in ``ppm``). A class's own counts in the
longest context are discounted and interpolated with shared lower orders, whose counts are
continuation counts over both classes: in how many different longer contexts a sequence occurs.
``own_levels`` tells at how many of the longest contexts a class has counts of its own. An expression that neither
class has seen thus gets the same probability from both, and one seen once moves little.
"""

from __future__ import annotations

import numpy as np

from fieldobs.llm.ppm import ALPHABET, _find, _low, context_length, pairs_of


def discount(counts: np.ndarray) -> float:
    """Absolute discount from the sequences seen once and twice."""
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.5


def _table(keys: np.ndarray, counts: np.ndarray):
    contexts, first, kinds = np.unique(keys >> 8, return_index=True, return_counts=True)
    totals = np.add.reduceat(counts, first) if len(first) else np.empty(0)
    return keys, counts.astype(np.float32), contexts, totals.astype(np.float32), kinds.astype(np.float32), discount(counts)


def _step(table, codes: np.ndarray, level: int, lower: np.ndarray) -> np.ndarray:
    """Interpolate ``lower`` with a level's discounted counts where the context is known."""
    keys, counts, contexts, totals, kinds, d = table
    at, there = _find(contexts, _low(codes, level + 1) >> 8)
    spot, hit = _find(keys, _low(codes, level + 1))
    p = lower.copy()
    if len(keys):
        own = np.where(hit, np.maximum(counts[spot].astype(float) - d, 0.0), 0.0)
        p[there] = ((own + d * kinds[at] * lower) / totals[at])[there]
    return p


class ClassModels:
    """Log-likelihoods of codes under each of the classes whose counts are given."""

    def __init__(self, codes: np.ndarray, counts: list[np.ndarray], order: int):
        self.order = order
        length = context_length(codes, order)
        pooled = sum(counts)
        self.shared, self.own = [], []
        for level in range(order + 1):
            # A class counts for itself where the context is as long as it gets: at the highest
            # level, and at lower ones in contexts that begin with their word.
            longest = length == level
            self.own.append([_table(*pairs_of(codes[longest], c[longest], length[longest], level)) for c in counts])
            if level < order:  # continuation counts: distinct longer sequences that end alike
                longer, _ = pairs_of(codes, pooled, length, level + 1)
                starts = np.unique(_low(codes[longest & (pooled > 0)], level + 1))
                keys, n = np.unique(np.concatenate([_low(longer, level + 1), starts]), return_counts=True)
                self.shared.append(_table(keys, n.astype(float)))

    def log_likelihood(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each code's byte in its context, a column per class."""
        length = context_length(codes, self.order)
        lower = np.full(len(codes), 1.0 / ALPHABET)
        out = np.empty((len(codes), len(self.own[0])))
        for level in range(self.order + 1):
            top = length == level
            for i, table in enumerate(self.own[level]):
                out[top, i] = _step(table, codes[top], level, lower[top])
            if level < self.order:
                deeper = length > level
                lower[deeper] = _step(self.shared[level], codes[deeper], level, lower[deeper])
        return np.log(out)

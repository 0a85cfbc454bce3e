"""Encoding and decoding with a SentencePiece BPE vocabulary, by vectorised merge rounds.

Merging works on flat numpy arrays: one symbol number per character of all words of a batch,
and the word each belongs to. A round looks up the rank of every neighbouring pair, takes the
smallest rank of each word by a segmented minimum, merges the leftmost non-overlapping pairs of
that rank in all words at once, and compacts the arrays; words without a pair leave. Rounds
end when no word is left. The result equals that of merging one best, leftmost pair after the
other, unless a merged symbol takes part in a pair of no higher rank than its own. The
vocabulary tells for which ranks this can happen; a word with several pairs of such a rank has
them merged one by one from the left, with all that follows from each, in one sweep.

Words here are stretches that no piece of the vocabulary reaches across: texts are cut between
characters that stand side by side in no piece, such as before a space that follows anything
else. Equal stretches are encoded once per worker and remembered, in bounded number. Everything
is one map without a shuffle; a task holds one group of texts of about a megabyte, or one text.

Supported are BPE vocabularies that normalise nothing but spaces and fall back to bytes; another
model raises a ``ValueError``. Defined cases: a null text is empty, an empty text has only the
begin and end ids and decodes to the empty text; the mark U+2581 counts as a space, as the
library has it. Repeated rows are encoded alike; an empty table gives no rows; other columns
are ignored. Ids outside of the vocabulary raise an ``IndexError`` in ``decode``.
"""

from __future__ import annotations

import codecs
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.llm.common import map_texts, text_bytes

SPACE = "▁"  # stands for a space inside pieces
_CUT, _NEXT = b"\xff", b"\xfe"  # no byte of UTF-8
_NONE = np.iinfo(np.int32).max  # the rank of a pair that does not merge

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, decoded string"


class Pieces:
    """The vocabulary as arrays: symbols of characters, ranks and products of pairs, bytes of ids.

    Symbols are the ids of normal pieces, and numbers beyond them for characters that occur
    in pieces without being one.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto.FromString(library.serialized_model_proto())
        form, kind = model.normalizer_spec, type(model.pieces[0])
        plain = form.name == "identity" and not form.precompiled_charsmap and not form.remove_extra_whitespaces
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain
                or not form.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix
                or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces)):
            raise ValueError(f"{path}: only BPE with byte fallback and without normalisation is supported")
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.dummy_prefix = form.add_dummy_prefix
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self._decoding(model.pieces, kind)
        self._characters(normal, len(model.pieces))
        self._pairs(normal, {i: model.pieces[i].score for i in normal.values()})
        self._walls(normal)

    def _decoding(self, pieces, kind) -> None:
        byte = {i: bytes([int(p.piece[3:5], 16)]) for i, p in enumerate(pieces) if p.type == kind.BYTE}
        self.byte_ids = np.zeros(256, np.int64)
        for i, value in byte.items():
            self.byte_ids[value[0]] = i
        self.control = np.array([p.type == kind.CONTROL for p in pieces])
        self.spaced = {i for i, p in enumerate(pieces) if p.type == kind.NORMAL and p.piece.startswith(SPACE)}
        unknown = " ⁇ "  # fixed value: the surface of an unknown piece
        self.bytes = [b"" if self.control[i] else byte[i] if i in byte else
                      unknown.encode() if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ").encode()
                      for i, p in enumerate(pieces)]

    def _characters(self, normal: dict[str, int], size: int) -> None:
        self.size = size
        self.symbols = dict(normal)
        for char in sorted(set("".join(normal)) - set(normal)):
            self.symbols[char] = size + len(self.symbols) - len(normal)
        single = sorted((ord(s), i) for s, i in self.symbols.items() if len(s) == 1)
        self.points, self.point_symbols = np.array(single, np.int64).reshape(-1, 2).T.copy()

    def _pairs(self, normal: dict[str, int], score: dict[int, float]) -> None:
        """Every way to put a piece together from two symbols; ranks by falling score."""
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: order[s] for i, s in score.items()}
        self.base = self.size + len(self.symbols)
        keys, made = [], []
        soonest: dict[int, int] = {}  # the lowest rank of the pieces a symbol is a part of
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                left, right = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    made.append(i)
                    for part in (left, right):
                        soonest[part] = min(soonest.get(part, _NONE), rank[i])
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.products = np.array(keys, np.int64)[at], np.array(made, np.int64)[at]
        self.ranks = np.array([rank[i] for i in self.products.tolist()], np.int32)
        self.swept = np.zeros(len(order), bool)  # ranks whose product may merge on at no higher rank
        for i in set(made):
            self.swept[rank[i]] |= soonest.get(i, _NONE) <= rank[i]
        self.of_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.products.tolist())))

    def _walls(self, normal: dict[str, int]) -> None:
        beside = {pair for piece in normal for pair in itertools.pairwise(piece)}
        self.beside = np.array(sorted((ord(a) << 21) | ord(b) for a, b in beside), np.int64)
        # By bytes, a space standing for its mark; characters beyond ASCII are cut by code points later.
        wall = np.zeros((256, 256), bool)
        wall[:128, :128] = True
        wall[0x80:0xFE, :128] = True
        wall[:128, 0xC0:0xFE] = True
        for a, b in beside:
            a, b = ((" " if c == SPACE else c) for c in (a, b))
            rows = [ord(a)] if a.isascii() else slice(0x80, 0xFE)
            columns = [ord(b)] if b.isascii() else slice(0xC0, 0xFE)
            if a.isascii() or b.isascii():
                wall[rows, columns] = False
        self.wall = wall.ravel()

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is in the table; -1 if it is no pair."""
        key = np.where((left >= 0) & (right >= 0), left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1) if len(self.keys) else np.full(len(key), -1)


class Rounds:
    """Symbols of many words, merged until no pair of them is left."""

    def __init__(self, pieces: Pieces, symbols: np.ndarray, word: np.ndarray):
        self.pieces = pieces
        self.symbols, self.word, self.place = symbols, word, np.arange(len(symbols))
        self.pair = np.full(len(symbols), -1)
        self.rank = np.full(len(symbols), _NONE, np.int32)
        self._look_up(np.arange(len(symbols)))

    def _look_up(self, at: np.ndarray) -> None:
        """Rank again the pairs that begin at these symbols."""
        self.pair[at] = -1
        at = at[at + 1 < len(self.symbols)]
        at = at[self.word[at] == self.word[at + 1]]
        self.pair[at] = self.pieces.pair(self.symbols[at], self.symbols[at + 1])
        self._rank()

    def _rank(self) -> None:
        self.rank = np.where(self.pair >= 0, self.pieces.ranks[self.pair], _NONE)

    def _keep(self, keep: np.ndarray) -> None:
        self.symbols, self.word, self.place = self.symbols[keep], self.word[keep], self.place[keep]
        self.pair, self.rank = self.pair[keep], self.rank[keep]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, index of the character each begins at), in order."""
        done_symbols, done_places = [], []
        while len(self.symbols):
            starts = np.flatnonzero(np.append(True, self.word[1:] != self.word[:-1]))
            sizes = np.diff(np.append(starts, len(self.word)))
            least = np.minimum.reduceat(self.rank, starts)
            over = np.repeat(least == _NONE, sizes)
            if over.any():
                done_symbols.append(self.symbols[over])
                done_places.append(self.place[over])
                self._keep(~over)
                least, sizes = least[least != _NONE], sizes[least != _NONE]
            if len(self.symbols):
                self._merge(least, sizes)
        symbols, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_places))
        order = np.argsort(places, kind="stable")
        return symbols[order], places[order]

    def _merge(self, least: np.ndarray, sizes: np.ndarray) -> None:
        hits = np.flatnonzero(self.rank == np.repeat(least, sizes))
        owner = np.repeat(np.arange(len(sizes)), sizes)[hits]
        several = np.bincount(owner, minlength=len(sizes)) > 1
        sweep = several & self.pieces.swept[least]
        gone, merged = [], []
        if sweep.any():
            begin = np.cumsum(sizes) - sizes
            for w in np.flatnonzero(sweep).tolist():
                dead, changed = self._sweep(int(begin[w]), int(sizes[w]), hits[owner == w].tolist(), int(least[w]))
                gone += dead
                merged += changed
                self.symbols[list(changed)] = list(changed.values())
            hits = hits[~sweep[owner]]
        # In a row of overlapping pairs every other one, from the left.
        place = np.arange(len(hits))
        head = np.append(True, np.diff(hits) != 1)[:len(hits)]
        chosen = hits[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0] if len(hits) else hits
        self.symbols[chosen] = self.pieces.products[self.pair[chosen]]
        keep = np.ones(len(self.symbols), bool)
        keep[chosen + 1] = False
        keep[gone] = False
        changed = np.zeros(len(self.symbols), bool)
        changed[chosen] = True
        changed[merged] = True
        changed = changed[keep]
        self._keep(keep)
        at = np.flatnonzero(changed)
        self._look_up(np.union1d(at, at[at > 0] - 1))

    def _sweep(self, begin: int, size: int, hits: list[int], rank: int) -> tuple[list[int], dict[int, int]]:
        """Merge the pairs of one word at ``hits`` in turn, each with what follows from it at no higher
        rank; returns the places that are gone and the new symbols of others."""
        pairs, base, stop = self.pieces.of_pair, self.pieces.base, begin + size
        symbol, behind, before, dead = {}, {}, {}, set()

        def at(i: int) -> int:
            return symbol[i] if i in symbol else int(self.symbols[i])

        def look(i: int, j: int) -> tuple[int, int]:
            if i < begin or j >= stop or at(i) < 0 or at(j) < 0:
                return _NONE, -1
            return pairs.get(at(i) * base + at(j), (_NONE, -1))

        for i in hits:
            if i in dead:
                continue
            j = behind.get(i, i + 1)
            found = look(i, j)
            while found[0] <= rank:
                symbol[i] = found[1]
                dead.add(j)
                behind[i] = after = behind.get(j, j + 1)
                before[after] = i
                left = before.get(i, i - 1)
                with_left, with_right = look(left, i), look(i, after)
                if with_left[0] <= with_right[0]:
                    i, j, found = left, i, with_left
                else:
                    j, found = after, with_right
        return list(dead), {i: s for i, s in symbol.items() if i not in dead}


class PieceEncoder:
    """Ids of whole texts, remembering the ids of stretches already met."""

    def __init__(self, path: str, remember: int = 300_000, keep: int = 100_000, longest: int = 64):
        self.pieces = Pieces(path)
        self.remember, self.keep, self.longest = remember, keep, longest
        self.ids: dict[bytes, bytes] = {}

    def trim(self) -> None:
        """Keep the stretches met first, which by and large are the frequent ones."""
        if len(self.ids) > self.keep:
            self.ids = dict(itertools.islice(self.ids.items(), self.keep))

    def stretches(self, texts: list[bytes]) -> list[list[bytes]]:
        """Each text, its spaces as they are, cut where no piece reaches across."""
        mark, prefix = SPACE.encode(), b" " if self.pieces.dummy_prefix else b""
        raw = np.frombuffer(_NEXT.join([prefix + t.replace(mark, b" ") if t else b"" for t in texts]), np.uint8)
        if not len(raw):
            return [[] for _ in texts]
        wall = self.pieces.wall[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
        cut = np.insert(raw, np.flatnonzero(wall) + 1, _CUT[0]).tobytes()
        return [t.split(_CUT) if t else [] for t in cut.split(_NEXT)]

    def merged(self, stretches: list[bytes]) -> list[bytes]:
        """The ids of many stretches, by merge rounds over all of them."""
        p = self.pieces
        words = [s.decode().replace(" ", SPACE) for s in stretches]
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words])
        at = np.minimum(np.searchsorted(p.points, points), len(p.points) - 1)
        symbols = np.where(p.points[at] == points, p.point_symbols[at], -1)
        ends = np.cumsum(sizes)
        begins = np.zeros(len(points), bool)
        begins[ends - sizes] = True
        pair = (points[:-1] << 21) | points[1:]
        spot = np.minimum(np.searchsorted(p.beside, pair), len(p.beside) - 1)
        begins[1:] |= p.beside[spot] != pair
        symbols, places = Rounds(p, symbols, np.cumsum(begins)).run()
        # Symbols that are no piece are single characters: their bytes stand for them.
        known = (symbols >= 0) & (symbols < p.size)
        ids, counts = symbols.copy(), np.ones(len(symbols), np.int64)
        lost = np.flatnonzero(~known)
        if len(lost):
            spelt = [chr(c).encode() for c in points[places[lost]].tolist()]
            counts[lost] = [len(s) for s in spelt]
            ids = np.repeat(ids, counts)
            firsts = (np.cumsum(counts) - counts)[lost]
            where = np.concatenate([np.arange(f, f + len(s)) for f, s in zip(firsts.tolist(), spelt)])
            ids[where] = p.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        edges = np.append(0, np.cumsum(counts))[np.searchsorted(places, np.append(0, ends))] * 4
        raw, edges = ids.astype("<u4").tobytes(), edges.tolist()
        return [raw[a:b] for a, b in itertools.pairwise(edges)]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if len(self.ids) > self.remember:
            self.trim()
        cut = self.stretches(texts)
        fresh = list(set().union(*cut).difference(self.ids))
        known, group, size, passing = self.ids, [], 0, []
        for n, stretch in enumerate(fresh, 1):
            group.append(stretch)
            size += len(stretch)
            if size > 1 << 18 or n == len(fresh):
                known.update(zip(group, self.merged(group)))
                passing += [s for s in group if len(s) > self.longest]
                group, size = [], 0
        ids = [b"".join(map(known.__getitem__, c)) for c in cut]
        for stretch in passing:
            del known[stretch]
        return ids


@functools.cache
def _encoder(path: str) -> PieceEncoder:
    """One per Python worker, which serves several tasks in turn."""
    return PieceEncoder(path)


@functools.cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("fieldobs.one_byte", _one_byte)


def text_of(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids: pieces in turn, marks as spaces, bytes that are no character as U+FFFD.

    Control pieces have no text, and no character reaches across one.
    """
    control = pieces.control[ids]
    shown = ids[~control]
    spelt = list(map(pieces.bytes.__getitem__, shown.tolist()))
    if pieces.dummy_prefix and len(shown) and int(shown[0]) in pieces.spaced:
        spelt[0] = spelt[0][1:]
    inside = np.flatnonzero(control) - np.arange(len(ids) - len(shown))
    edges = [0, *sorted(set(inside.tolist()) - {0, len(shown)}), len(shown)]
    return "".join(b"".join(spelt[x:y]).decode("utf-8", "fieldobs.one_byte") for x, y in itertools.pairwise(edges))


def _groups(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) as ids: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        first = np.array([encoder.pieces.begin], "<u4").tobytes() if begin else b""
        last = np.array([encoder.pieces.end], "<u4").tobytes() if end else b""
        for batch in batches:
            ids = [first + i + last for group in _groups(batch.column("text").to_pylist()) for i in encoder(group)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"])
        encoder.trim()  # the worker goes on to other work

    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return map_texts(read, run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encode``'s rows with the text that their ids stand for in ``decoded``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            texts = [text_of(pieces, np.frombuffer(i.as_py(), "<u4")) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return map_texts(encoded.select("doc_id", "n_tokens", "ids"), run, DECODED)

"""Best-fit packing of documents into training sequences.

Bounded-space online best-fit: every task reads its share of the documents as a stream and
keeps a fixed number of open bins. A bitset has one bit for each amount of free space that
some open bin has, so the tightest bin that still holds a piece is the lowest set bit from
the piece's length on. When a piece fits nowhere and all bins are open, the fullest closes
first. What is still open at the end of the stream has been handed to nobody, so it is packed
once more, longest piece first.

A task's memory is its open bins, one batch of texts and of pieces, and the ids of words met. Nothing is shuffled: the sequences
of a task hold documents of that task, at the cost of about one partly filled sequence each.
Sequence numbers come from the partition and a counter, so a task that runs again after a
lost executor numbers its sequences alike.

Defined cases: a null text is empty and still yields its end token; repeated rows are packed
as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.llm.common import map_texts, text_bytes, trim_heap

PIECES = ("doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


class OpenBins:
    """A fixed number of open bins, found by free space through a bitset."""

    def __init__(self, capacity: int, slots: int):
        self.capacity, self.slots = capacity, slots
        self.bits, self.count = 0, 0
        self.by_space: dict[int, list[list]] = {}

    def _put(self, space: int, pieces: list) -> None:
        self.by_space.setdefault(space, []).append(pieces)
        self.bits |= 1 << space
        self.count += 1

    def _take(self, space: int) -> list:
        at = self.by_space[space]
        pieces = at.pop()
        if not at:
            del self.by_space[space]
            self.bits &= ~(1 << space)
        self.count -= 1
        return pieces

    def add(self, piece: tuple, length: int) -> list | None:
        """Place a piece in the tightest bin; return the bin that had to close for it."""
        fitting = self.bits >> length
        closed = None
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            pieces = self._take(space)
        else:
            if self.count >= self.slots:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
            space, pieces = self.capacity, []
        pieces.append(piece)
        if space == length:
            return pieces if closed is None else closed + [None] + pieces
        self._put(space - length, pieces)
        return closed

    def drain(self) -> list[list]:
        return [pieces for at in self.by_space.values() for pieces in at]


def _split_closed(closed: list | None) -> Iterator[list]:
    """A closing may hand out two bins, divided by None."""
    if closed:
        if None in closed:
            cut = closed.index(None)
            yield closed[:cut]
            yield closed[cut + 1:]
        else:
            yield closed


def pack_stream(pieces: Iterable[tuple], capacity: int, slots: int) -> Iterator[list[tuple]]:
    """Bins of pieces ``(doc_id, piece, start, ids)``, as they close."""
    bins = OpenBins(capacity, slots)
    for piece in pieces:
        yield from _split_closed(bins.add(piece, len(piece[3])))
    rest = sorted((p for b in bins.drain() for p in b), key=lambda p: -len(p[3]))
    last = OpenBins(capacity, max(1, len(rest)))
    for piece in rest:
        yield from _split_closed(last.add(piece, len(piece[3])))
    yield from last.drain()


_LETTER = np.isin(np.arange(256), np.frombuffer(string.ascii_lowercase.encode(), np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), np.uint8))


class WordEncoder:
    """Token ids of whole texts, remembering the ids of word parts already met.

    The vocabulary lower-cases, drops white space, and never merges across it nor from a letter
    to a punctuation mark behind it. So texts are cut at these places, each distinct part goes
    through the tokenizer once, and a text's ids are its parts' ids in turn. A text that holds
    the string of a special token goes through the tokenizer whole.
    """

    def __init__(self, path: str, remember: int = 120_000, keep: int = 60_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # Words of a-z alone need no normalising, and white space is all there is to cut them at.
        self.plain = None, pre_tokenizers.WhitespaceSplit()
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.worded = bool(self.ends.any())
        self.remember, self.keep = remember, keep
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        self.separator = next(iter(added), None)
        self.ids: dict[bytes, bytes] = {}

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of a-z in one call; the token that ends a word tells where the next begins."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.plain
        encoded = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole
        ids = np.array(encoded[0].ids, "<u4")
        raw, stops = ids.tobytes(), (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
        return [raw[a:b] for a, b in itertools.pairwise([0, *stops])]

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of many parts in one call, with a special token between them."""
        words = [p.decode() for p in parts]
        if self.separator is None:
            encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in encoded]
        encoded = self.tokenizer.encode_batch_fast([self.specials[0].join(words)], add_special_tokens=False)
        ids = np.array(encoded[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.separator)
        raw, starts, stops = ids.tobytes(), np.append(0, cuts + 1) * 4, np.append(cuts, len(ids)) * 4
        return [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]

    def trim(self) -> None:
        """Keep the parts met first, which by and large are the frequent ones."""
        if len(self.ids) > self.keep:
            self.ids = dict(itertools.islice(self.ids.items(), self.keep))

    @staticmethod
    def parts(text: bytes) -> list[bytes]:
        """Cut a text of lower-case A-Z at white space, and before a mark that follows a letter."""
        raw = np.frombuffer(text, np.uint8)
        cuts = np.flatnonzero(_LETTER[raw[:-1]] & _MARK[raw[1:]]) + 1
        return np.insert(raw, cuts, 0x20).tobytes().split()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.ids) > self.remember:
            self.trim()
        special = [s.lower().encode() for s in self.specials]
        lower, whole = [t.lower() for t in texts], {}
        for i, text in enumerate(lower):
            if any(s in text for s in special):
                lower[i] = b""
                whole[i] = np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, "<u4")
        cut = [self.parts(text) for text in lower]
        fresh = set().union(*cut).difference(self.ids)
        words = [part for part in fresh if self.worded and part.isalpha()]
        for encode, parts in ((self._encode_words, words), (self._encode_parts, list(fresh.difference(words)))):
            for at in range(0, len(parts), 2000):
                part = parts[at:at + 2000]
                self.ids.update(zip(part, encode(part), strict=True))
        get = self.ids.__getitem__
        return [whole[i] if i in whole else np.frombuffer(b"".join(map(get, c)), "<u4") for i, c in enumerate(cut)]


def chunks(texts: list[bytes], most: int = 256, size: int = 1 << 20) -> Iterator[slice]:
    """Ranges of at most ``most`` texts; one ends with the text that takes it to ``size`` bytes."""
    start = held = 0
    for at, text in enumerate(texts, 1):
        held += len(text)
        if at - start == most or held >= size or at == len(texts):
            yield slice(start, at)
            start, held = at, 0


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One per Python worker, which serves several tasks in turn."""
    return WordEncoder(path)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
         open_bins: int = 512) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    A document is its token ids and one ``end_id``; only longer ones are cut, into pieces of
    ``capacity``. Returns a row per piece: doc_id, piece, start, length, ids (little-endian
    unsigned 32-bit), sequence_id, offset.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        end = np.array([end_id], "<u4")

        def pieces():
            for batch in batches:
                doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for part in chunks(texts):
                    for doc_id, ids in zip(doc_ids[part], encode(texts[part])):
                        ids = np.concatenate([ids, end])
                        for piece, start in enumerate(range(0, len(ids), capacity)):
                            yield doc_id, piece, start, ids[start:start + capacity]
                    trim_heap()  # cutting a text into words frees as much as all that is kept

        sequence = TaskContext.get().partitionId() << 33
        rows = []
        for closed in pack_stream(pieces(), capacity, open_bins):
            offset = 0
            for doc_id, piece, start, ids in closed:
                rows.append((doc_id, piece, start, len(ids), ids.tobytes(), sequence, offset))
                offset += len(ids)
            sequence += 1
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
        encode.trim()  # the worker goes on to other work

    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return map_texts(read, run, PIECES, rows=500)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])


def digest(packed: DataFrame) -> DataFrame:
    """The packing with a checksum in place of the ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")

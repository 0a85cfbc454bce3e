"""Fill-in-the-middle transformation by piece tables.

A document is never copied while it is rearranged. It becomes a table of descriptors
(buffer, start, length) over two immutable buffers: the bytes of its text and the three sentinels.
Cutting splits a descriptor in two, an arrangement is a permutation of the descriptors with
sentinels between them, and only the finished table is read out, descriptor by descriptor, into
the hash and the output. Restoring goes the same way back: the sentinels found in the output
split one descriptor over it, the inverse permutation orders the parts, and they are streamed.

A text is cut between units: a run of the letters A-Z and a-z, or any other character. Where
it is cut, whether it is cut at all, and the arrangement depend on the document's id alone, so
a task that runs again after a lost executor gives the same rows. Everything is one map without
a shuffle; a task holds one batch of documents.

Defined cases: a null text is empty; an empty text, one that holds a sentinel, and a share of
all others stay plain. A null id draws as an empty one does. Repeated rows are transformed
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldobs.llm.common import map_texts, text_bytes

#: The sentinel buffer, and where each one lies in it.
SENTINELS = b"<P><S><M>"
MARKS = {"P": (0, 3), "S": (3, 3), "M": (6, 3)}
#: The order of the parts in each form; their own order is prefix, middle, suffix.
PARTS = "PMS"
ARRANGEMENTS = {"psm": "PSM", "spm": "SPM"}
TEXT, SENTINEL = 0, 1

MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
RESTORED = MADE + ", restored string, restored_sha256 string"

_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= ord("a")) & ((_BYTE | 32) <= ord("z")) & (_BYTE < 128)
_STARTS = (_BYTE & 0xC0) != 0x80  # the first byte of a character


class PieceTable:
    """Descriptors (buffer, start, length) over immutable buffers."""

    def __init__(self, text: bytes, pieces: Iterable[tuple[int, int, int]] | None = None):
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else list(pieces)

    def cut(self, *offsets: int) -> PieceTable:
        """Split the descriptors that the ascending ``offsets`` of the document fall into.

        Every offset yields a boundary, so equal ones leave an empty piece between them.
        """
        pieces, at = [], 0
        rest = list(offsets)
        for buffer, start, length in self.pieces:
            begin = at
            while rest and rest[0] <= begin + length:
                here = rest.pop(0)
                pieces.append((buffer, start + at - begin, here - at))
                at = here
            pieces.append((buffer, start + at - begin, begin + length - at))
            at = begin + length
        return PieceTable(self.buffers[TEXT], pieces)

    def arranged(self, order: str) -> PieceTable:
        """The parts prefix, middle, suffix in another order, each behind its sentinel."""
        of = dict(zip(PARTS, self.pieces))
        return PieceTable(self.buffers[TEXT], [
            piece for name in order for piece in ((SENTINEL, *MARKS[name]), of[name])])

    def in_order(self, order: str) -> PieceTable:
        """Undo ``arranged``: sentinels go, the parts return to their own order."""
        return PieceTable(self.buffers[TEXT], [self.pieces[2 * order.index(name) + 1] for name in PARTS])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def read(self) -> bytes:
        return b"".join(self.stream())


def unit_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which the units of a text begin."""
    raw = np.frombuffer(text, np.uint8)
    letter = _LETTER[raw]
    begins = _STARTS[raw]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def characters(part: bytes | memoryview) -> int:
    return int(np.count_nonzero(_STARTS[np.frombuffer(part, np.uint8)]))


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four 32-bit numbers from the hash of ``seed:doc_id``."""
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(key[at:at + 8], 16) for at in (0, 8, 16, 24))


def rearrange(doc_id: int | None, text: bytes, seed: int = 1, percent: int = 90,
              spm_percent: int = 20) -> tuple[int, str, int | None, int | None, PieceTable]:
    """(units, form, prefix characters, middle characters, table) of one document."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    marked = any(SENTINELS[a:a + size] in text for a, size in MARKS.values())
    if not n or marked or h3 % 100 >= percent:
        return n, "plain", None, None, PieceTable(text)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    first, second = (int(starts[k]) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    cut = PieceTable(text).cut(first, second)
    prefix, middle, _ = cut.stream()
    return n, form, characters(prefix), characters(middle), cut.arranged(ARRANGEMENTS[form])


def original(output: bytes, form: str) -> PieceTable:
    """The table of the document that ``rearrange`` made ``output`` from."""
    if form not in ARRANGEMENTS:
        return PieceTable(output)
    order, offsets, at = ARRANGEMENTS[form], [], 0
    for name in order:  # the text itself holds no sentinel
        start, size = MARKS[name]
        at = output.index(SENTINELS[start:start + size], at)
        offsets += [at, at + size]
        at += size
    table = PieceTable(output).cut(*offsets)
    return PieceTable(output, table.pieces[1:]).in_order(order)


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) in its fill-in-the-middle form.

    ``percent`` of the documents are cut, ``spm_percent`` of these with the suffix first. Returns
    doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain),
    output and output_sha256.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, form, prefix, middle, made = rearrange(doc_id, text, seed, percent, spm_percent)
                rows.append((doc_id, n, form, prefix, middle, made.read(), made.sha256()))
            yield _batch(rows, MADE)

    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return map_texts(read, run, MADE)


def restore(made: DataFrame) -> DataFrame:
    """``transform``'s rows with the text rebuilt from output and form: restored, restored_sha256."""
    names = [f.split()[0] for f in MADE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*[batch.column(c).to_pylist() for c in names]):
                table = original(row[5], row[2])
                rows.append((*row, table.read(), table.sha256()))
            yield _batch(rows, RESTORED)

    return map_texts(made.select(*names[:5], F.col("output").cast("binary"), "output_sha256"), run, RESTORED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    arrays = []
    for (name, kind), values in zip(fields, columns):
        if name in ("output", "restored"):  # UTF-8 already
            arrays.append(pa.array(values, pa.binary()).cast(pa.string()))
        else:
            arrays.append(pa.array(values, kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])

"""Fill-in-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that are never
changed: the UTF-8 bytes of its text and the sentinels. Cutting splits a descriptor,
an arrangement puts descriptors in another order with sentinels between them, and the
inverse order gives the text back. Bytes are copied once, when the output is written;
hashes read the buffers through the descriptors.

Units are runs of A-Z and a-z, and every other character by itself. Two numbers drawn from
the hash of seed and id cut a document of n units into prefix, middle and suffix, which may
be empty. A text that is empty, holds a sentinel or is drawn to stay as it is keeps the form
``plain``; others become ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).

Every row is worked on alone, so nothing is shuffled and a group of copies is no hot key.

Results for special rows: a null text is empty and plain with n = 0; a text of blanks has one
unit a character; a null id is hashed as the empty string; repeated rows give equal rows; two
equal cuts give an empty middle; an empty table gives no rows; columns of any name are left
alone. A text of any length is cut whole, in memory of about ten times its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import as_bytes

#: Marks before prefix, suffix and middle.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: The order of the parts in each form.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
READING = ("prefix", "middle", "suffix")
#: Of 100 documents so many are transformed, and of 100 of these so many are spm.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"

TEXT, MARKS = 0, 1
_MARKS = b"".join(SENTINELS.values())
_MARK_AT = {part: (MARKS, _MARKS.index(mark), _MARKS.index(mark) + len(mark)) for part, mark in SENTINELS.items()}

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, end) over buffers that never change."""

    buffers: tuple[bytes, ...]
    pieces: tuple[Piece, ...]

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls((text, _MARKS), ((TEXT, 0, len(text)),))

    def __len__(self) -> int:
        return sum(end - start for _, start, end in self.pieces)

    def cut(self, *places: int) -> PieceTable:
        """The same bytes with a boundary at each place (ascending offsets). A place on a boundary
        adds an empty piece, so that k places in one piece always make k + 1 of it."""
        out, left, at = [], list(places), 0
        for k, (buffer, start, end) in enumerate(self.pieces):
            last = k == len(self.pieces) - 1
            while left and (left[0] < at + end - start or last):
                middle = min(start + left.pop(0) - at, end)
                out.append((buffer, start, middle))
                at, start = at + middle - start, middle
            out.append((buffer, start, end))
            at += end - start
        return PieceTable(self.buffers, tuple(out))

    def arranged(self, order: list[int]) -> PieceTable:
        """Pieces in another order; ``inverse(order)`` undoes it."""
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def marked(self, parts: tuple[str, ...]) -> PieceTable:
        """A sentinel before each piece."""
        return PieceTable(self.buffers, tuple(p for part, piece in zip(parts, self.pieces) for p in (_MARK_AT[part], piece)))

    def __iter__(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        return (views[buffer][start:end] for buffer, start, end in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self:
            digest.update(view)
        return digest.hexdigest()

    def text(self) -> bytes:
        return b"".join(self)


def inverse(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for i, place in enumerate(order):
        out[place] = i
    return out


def unit_starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offset of each unit in bytes, and in characters; both end with the length of the text."""
    b = np.frombuffer(text, np.uint8)
    letter = ((b | 0x20) >= 0x61) & ((b | 0x20) <= 0x7A)
    begins = (b & 0xC0) != 0x80
    inside = np.zeros(len(b), bool)
    inside[1:] = letter[1:] & letter[:-1]
    units = np.append(np.flatnonzero(begins & ~inside), len(b))
    chars = np.append(np.cumsum(begins) - 1, begins.sum())
    return units, chars[units]


def draws(key: bytes | None, seed: str = SEED) -> list[int]:
    digest = hashlib.sha256(seed.encode() + b":" + (key or b"")).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: bytes, drawn: list[int], transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> dict:
    """Units, form, sizes and piece table of the output of one document."""
    units, chars = unit_starts(text)
    n = len(units) - 1
    first, second, keep, kind = drawn
    table = PieceTable.of(text)
    if not text or keep % 100 >= transformed or any(mark in text for mark in SENTINELS.values()):
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "table": table}
    low, high = sorted((first % (n + 1), second % (n + 1)))
    form = "spm" if kind % 100 < suffix_first else "psm"
    parts = FORMS[form]
    order = [READING.index(part) for part in parts]
    table = table.cut(int(units[low]), int(units[high])).arranged(order).marked(parts)
    sizes = {"prefix_chars": int(chars[low]), "middle_chars": int(chars[high] - chars[low])}
    return {"n": n, "form": form, **sizes, "table": table}


def restore(output: bytes, form: str) -> PieceTable:
    """The text of an output as pieces of it. No text that is transformed holds a sentinel, and none
    can arise where pieces meet, so each sentinel stands once."""
    whole = PieceTable.of(output)
    parts = FORMS.get(form)
    if parts is None:
        return whole
    places = [output.index(SENTINELS[part]) for part in parts]
    edges = [edge for part, at in zip(parts, places) for edge in (at, at + len(SENTINELS[part]))]
    marked = whole.cut(*edges)
    bare = PieceTable(marked.buffers, marked.pieces[2::2])  # what follows each sentinel
    return bare.arranged(inverse([READING.index(part) for part in parts]))


_DDL = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED,
    transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``doc_id``, units, form, sizes of prefix and middle, output text and its hash, for every row."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, texts in batches:
            rows = []
            for key, body in zip(as_bytes(keys), as_bytes(texts)):
                made = transform(body or b"", draws(key, seed), transformed, suffix_first)
                table = made.pop("table")
                rows.append({**made, "output": table.text().decode(), "output_sha256": table.sha256()})
            yield pa.array(rows, _KIND)

    made = F.arrow_udf(run, f"struct<{_DDL}>")(docs[doc_id].cast("string"), docs[text])
    return docs.select(docs[doc_id], made.alias("_made")).select(doc_id, "_made.*")


_KIND = pa.struct([
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output", pa.string()), ("output_sha256", pa.string()),
])


def _restorer(batches: Iterator[tuple[pa.Array, pa.Array]], give) -> Iterator[pa.Array]:
    for outputs, forms in batches:
        pairs = zip(as_bytes(outputs), forms.to_pylist())
        yield pa.array([give(restore(output or b"", form)) for output, form in pairs], pa.string())


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output of ``form`` was made from."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _restorer(batches, lambda table: table.text().decode())

    return F.arrow_udf(run, "string")(output, form)


def restored_sha256(output: Column, form: Column) -> Column:
    """Hash of the text that an output of ``form`` was made from, read through its pieces."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _restorer(batches, PieceTable.sha256)

    return F.arrow_udf(run, "string")(output, form)

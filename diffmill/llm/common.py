"""What several operators share: word kernels for use inside Spark tasks, and stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WHITE = b" \t\n\v\f\r"
#: Maps A-Z to a-z and whatever is no letter, digit or non-ASCII byte to a space.
PLAIN_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
#: Rows whose texts are Python objects at once.
PIECE = 1024
_BASE = 0x9E3779B97F4A7C55  # odd, so that its powers can be inverted
_SPREAD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.Array | pa.RecordBatch) -> Iterator[pa.Array | pa.RecordBatch]:
    """A batch in slices of a few rows each, so that a task holds what it derives from few texts at once."""
    return (batch.slice(i, PIECE) for i in range(0, len(batch), PIECE))


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, of few texts at once."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for piece in pieces(column):
        yield from piece.cast(kind).to_pylist()


def judged(docs: DataFrame, ids: str | list[str], text: str, make: Callable[[], Callable], ddl: str) -> DataFrame:
    """The ``ids`` columns and the fields of ``ddl`` that a judge of texts returns as a dictionary.

    ``make`` builds the judge once in each task. Texts go to Python in Arrow batches and
    nothing is shuffled; no other column of ``docs`` is read. A filter on the result does not judge again:
    a plain column would be repeated in it, and a task would run two workers.
    """
    kind = to_arrow_type(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = make()
        for texts in chain.from_iterable(map(pieces, batches)):
            yield pa.array([judge(t) for t in as_bytes(texts)], kind)

    ids = [ids] if isinstance(ids, str) else ids
    result = F.arrow_udf(run, f"struct<{ddl}>").asNondeterministic()(docs[text]).alias("_judged")
    return docs.select(*[docs[c] for c in ids], result).select(*ids, "_judged.*")


def plain_words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(PLAIN_WORDS).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (self._chain(b, size) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _chain(base: int, size: int) -> np.ndarray:
        out = np.full(size, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words between white space: a 64-bit hash, start and end in bytes.

    A polynomial over the bytes, summed once for the whole text, gives the hash of any
    stretch of it, so no word is made a Python object.
    """
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_WHITE[b], [True]))))
    starts, ends = edge[::2], edge[1::2]
    up, down = _POWERS(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words; of all words if they are fewer; none for none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        return mix((words * _SPREAD[:n]).sum(keepdims=True) + np.uint64(n))
    total = words[: n - width + 1] * _SPREAD[0]
    for i in range(1, width):
        total += words[i : n - width + 1 + i] * _SPREAD[i]
    return mix(total)


def shingle_set(raw: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text in lower case (A-Z only), sorted."""
    return np.unique(shingle_hashes(word_hashes(raw.lower())[0], width)) if raw else np.empty(0, np.uint64)

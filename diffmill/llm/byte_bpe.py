"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

A task gathers the distinct pattern matches ("words") of its texts and lays their bytes out in one
array of tokens with links to the left and right. An index from each adjacent pair, named by
the rank of its merge, to the positions where it stands is built once. Ranks are then replayed in
order: all positions of a rank merge at once, and only the pairs to the left and right of a
merge are looked up and entered anew. So a word costs the same however often it occurs, and a merge costs
nothing where its pair does not stand. Texts are put together from their words' ids.

Equal ranks merge from the left: of positions that overlap in a run every second one is taken. In a rank
file in which a merge can open a pair of lower rank, order matters within a word; such words are
found (the new rank is below the current one) and encoded one by one.

Texts are independent, so nothing is shuffled. A task replays the new words of about ``GROUP_CHARS`` characters
of text together; words once encoded are kept for its next texts up to ``KEPT_BYTES``, and then dropped
and gathered anew. Neither bound changes a result.

Results for special rows: a null text is the empty text, without tokens; blanks and control characters
are words like others; repeated rows give equal rows; ids and extra columns are left alone; an empty
table gives no rows. A text of any length is encoded whole; one of over ``LONG_TEXT`` characters is matched
as a stream instead of a list. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of distinct words that a task keeps, and characters of texts whose new words are replayed together.
KEPT_BYTES = 4 << 20
GROUP_CHARS = 2 << 20
LONG_TEXT = 1 << 20
_NONE = np.int64(1) << 62


class Vocabulary:
    """Token bytes by id, and the rank that each pair of tokens merges to."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.size = max(ranks.values(), default=-1) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[order], _NONE)
        self.pair_ranks = np.append(np.array(merged, np.int64)[order], _NONE)
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair merges to; a very large number for none."""
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def load_vocabulary(name: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    """The vocabulary of a rank file: a path, or the name of a public one. Read once in each process."""
    return _vocabulary(name if os.path.isabs(name) else public_tokenizers.path(name), pattern)


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]


def replay(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words (none empty) one after another, and the number of each word's ids."""
    sizes = np.array([len(w) for w in words], np.int64)
    joined = np.frombuffer(b"".join(words), np.uint8)
    n = len(joined)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    token = vocabulary.byte_ids[joined]
    # place n ends every word on both sides and merges with nothing
    left, right = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    ends = np.cumsum(sizes)
    left[ends - sizes] = n
    right[ends - 1] = n
    token, alive = np.append(token, np.int32(-1)), np.ones(n + 1, bool)
    alive[n] = False
    lone = np.zeros(len(words), bool)

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        """The pairs that begin at the positions, by rank."""
        at = at[(at < n) & (right[at] < n)]
        ranks = vocabulary.merges(token[at], token[right[at]])
        found = ranks < _NONE
        at, ranks = at[found], ranks[found]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        edges = np.flatnonzero(np.diff(ranks, prepend=-1))
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
            rank = int(ranks[start])
            if rank not in index:
                index[rank] = []
                heapq.heappush(queue, rank)
            index[rank].append(at[start:end])

    enter(np.flatnonzero(right[:n] < n).astype(np.int32))
    while queue:
        rank = heapq.heappop(queue)
        held = index.pop(rank)
        at = np.sort(np.concatenate(held))
        after = right[at]
        good = alive[at] & (after < n)
        good[1:] &= at[1:] != at[:-1]
        at, after = at[good], after[good]
        good = vocabulary.merges(token[at], token[after]) == rank
        at, after = at[good], after[good]
        if not len(at):
            continue
        # where one position's partner is the next position, every second one of the run merges
        follows = np.zeros(len(at), bool)
        follows[1:] = at[1:] == after[:-1]
        if follows.any():
            place = np.arange(len(at))
            take = (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0
            at, after = at[take], after[take]
        beyond = right[after]
        near = beyond[:-1][at[1:] == beyond[:-1]]  # merge next to the left one, which saw it unmerged
        if len(near):
            lone[word[near[vocabulary.merges(np.full(len(near), rank), token[near]) < rank]]] = True
        token[at] = rank
        alive[after] = False
        right[at] = beyond
        left[beyond] = at
        left[n] = right[n] = n
        touched = np.concatenate((at, left[at]))
        touched = touched[touched < n]
        fresh = touched[right[touched] < n]
        if len(fresh):
            lower = vocabulary.merges(token[fresh], token[right[fresh]]) < rank
            if lower.any():
                lone[word[fresh[lower]]] = True
            enter(fresh)

    alive = alive[:n]
    ids, counts = token[:n][alive], np.bincount(word[alive], minlength=len(words))
    whole = [vocabulary.ranks.get(w, -1) for w in words]
    special = lone | ((np.array(whole) >= 0) & (counts > 1))
    if not special.any():
        return ids, counts
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for i in np.flatnonzero(special).tolist():
        parts[i] = np.array([whole[i]] if whole[i] >= 0 else one_by_one(vocabulary, words[i]), np.int64)
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def one_by_one(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """Ids of one word: always the lowest rank next, from the left."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        ranks = [vocabulary.ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [vocabulary.ranks[p] for p in parts]


class _Numbers(dict):
    """Words by number, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes batches of texts, keeping the words of earlier ones."""

    def __init__(self, vocabulary: Vocabulary, kept_bytes: int = KEPT_BYTES):
        self.vocabulary, self.kept_bytes = vocabulary, kept_bytes
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.held = _Numbers(), 0
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text or "")
            if chars > GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if self.held > self.kept_bytes:
            self._forget()
        number, known = self.numbers.__getitem__, len(self.numbers)
        used = [np.fromiter(map(number, self._matches(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
        self._learn(known)
        for words in used:
            yield gathered(self.ids, self.starts[words], self.counts[words])

    def _matches(self, text: str) -> Iterable[str]:
        pattern = self.vocabulary.words
        return pattern.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in pattern.finditer(text))

    def _learn(self, known: int) -> None:
        fresh = [w.encode() for w in islice(self.numbers, known, None)]
        if not fresh:
            return
        ids, counts = replay(self.vocabulary, fresh)
        self.held += sum(map(len, fresh))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.ids = np.append(self.ids, ids)


def packed(values: Iterable[bytes | None]) -> pa.Array:
    """Byte strings as one array, without a list of them in between."""
    data, ends, missing = bytearray(), [0], []
    for value in values:
        missing.append(value is None)
        data += value or b""
        ends.append(len(data))
    valid = pa.array(np.logical_not(missing)).buffers()[1] if any(missing) else None
    return pa.Array.from_buffers(pa.binary(), len(missing), [valid, pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = RANKS) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(load_vocabulary(name))
        for texts in batches:
            values = (t.as_py() for t in texts)
            yield packed(ids.astype("<u4").tobytes() for ids in encoder(values))

    return docs.select(docs[doc_id], F.arrow_udf(run, "binary")(docs[text]).alias("ids"))


def decode(encoded: DataFrame, ids: str = "ids", name: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids; null for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load_vocabulary(name)

        for rows in batches:
            raw = (r.as_py() for r in rows)
            yield packed(None if ids is None else vocabulary.decode(np.frombuffer(ids, "<u4")) for ids in raw)

    return encoded.withColumn("decoded", F.arrow_udf(run, "binary")(encoded[ids]))

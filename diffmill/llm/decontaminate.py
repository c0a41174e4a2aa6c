"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of 13 words (an item of fewer words is one window).
A window is contained in a document only if all its tokens are, so for containment of 1 the
necessary prefix of a window, its tokens ordered by rarity in the whole corpus, is its single
rarest token. Only places of prefix tokens are candidates; the token's offset in the window
bounds where the window can lie, the window's length must fit into the document, and what
passes is verified word by word over an item-sized window.

The benchmark is a stated query set. It is taken in blocks of bounded size, each broadcast
in turn: a document passes all blocks in one pass over the texts and is never shuffled, however
hot a passage is. Token frequencies are counted over all documents, combined in each task.

Defined results: a null or empty text has no words and no hits; an empty benchmark hits nothing;
items without words hit nothing; an item whose id is null marks words but is not listed; repeated
items of one id count once. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from diffmill.llm.common import as_bytes, pieces, plain_words

WINDOW = 13
#: Most bytes of item text in one broadcast block.
BLOCK_BYTES = 4_000_000


def windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def token_counts(docs: DataFrame, text_col: str, tokens: set[bytes]) -> dict[bytes, int]:
    """How often each token occurs in all documents. A task sends one row per token at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                total.update(filter(tokens.__contains__, plain_words(text)))
        yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    counted = docs.select(docs[text_col].alias("text")).mapInArrow(count, "token binary, n bigint")
    return {bytes(r.token): r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Windows of one block of items, by their rarest token."""

    def __init__(self, items: list[tuple[object, bytes]], width: int, counts: dict[bytes, int]):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            for window in windows(plain_words(text), width):
                owners[window].add(item)
        self.by_prefix: dict[bytes, list] = defaultdict(list)
        for window, ids in owners.items():
            rarest = min(window, key=lambda t: (counts.get(t, 0), t))
            self.by_prefix[rarest].append((window.index(rarest), len(window), list(window), sorted(ids, key=str)))
        self.by_prefix = dict(self.by_prefix)

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Places (start, end) of windows in the words, and the ids of their items."""
        n, places, items = len(words), [], set()
        by_prefix = self.by_prefix
        if by_prefix.keys().isdisjoint(words):
            return places, items
        for at, word in enumerate(words):
            for offset, length, window, ids in by_prefix.get(word, ()):
                start = at - offset
                if start >= 0 and start + length <= n and words[start : start + length] == window:
                    places.append((start, start + length))
                    items.update(ids)
        return places, items


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``keep`` columns (doc_id) with n_words, hits (merged word spans of occurring windows)
    and items (ids of items with occurring windows, sorted as strings).

    The number of blocks follows the size of the benchmark alone. Each block costs one count of
    its tokens over the corpus; the judging pass reads the corpus once for all of them.
    """
    spark, keep = docs.sparkSession, ["doc_id"] if keep is None else keep
    items = benchmark.select(
        benchmark[item_col].alias("item"), F.encode(F.coalesce(benchmark[item_text_col], F.lit("")), "UTF-8").alias("words")
    )
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = 1 + size // block_bytes
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    rows = docs.select(*[docs[c] for c in keep], docs[text_col].alias("_text"))
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == b).collect()
        texts = [(None if r.item is None else str(r.item), bytes(r.words)) for r in block]
        counts = token_counts(docs, text_col, {w for _, t in texts for w in plain_words(t)})
        sent = spark.sparkContext.broadcast(Index(texts, width, counts))
        rows = _judge(rows, sent, keep, fields, first=b == 0)
    return rows.drop("_text")


def _judge(rows: DataFrame, sent, keep: list[str], fields: list[T.StructField], first: bool) -> DataFrame:
    """Add what one block finds to what the blocks before it have found."""
    out = T.StructType([rows.schema[c] for c in keep] + [T.StructField("_text", T.StringType()), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in chain.from_iterable(map(pieces, batches)):
            hits = [[]] * len(batch) if first else batch.column("hits").to_pylist()
            items = [[]] * len(batch) if first else batch.column("items").to_pylist()
            n, spans, names = [], [], []
            for text, had, known in zip(as_bytes(batch.column("_text")), hits, items):
                words = plain_words(text)
                places, found = index(words)
                places = merged(places + [(h["start"], h["end"]) for h in had])
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in places])
                names.append(sorted({x for x in found if x is not None} | set(known)))
            results = [pa.array(x, kind) for x, kind in zip((n, spans, names), kinds)]
            columns = [batch.column(c) for c in [*keep, "_text"]] + results
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(judge, out)


def contaminated(n_hit, n_words):
    """The contract's rule: some word is hit, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def hit_words():
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["end"] - h["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    whole = docs.select(F.struct("*").alias("_row"), docs[text_col].alias(text_col))
    found = find_contamination(whole, benchmark, ["_row"], text_col)
    return found.where(~contaminated(hit_words(), F.col("n_words"))).select("_row.*")

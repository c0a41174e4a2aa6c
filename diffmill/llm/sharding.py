"""Sharding in Hilbert-curve order.

Language, source, length and id are each quantised to 256 levels, in their own order: numbers between
their least and greatest value, texts by their first six bytes as a number. The levels of a document
are a cell of a four-dimensional grid, and its index on the Hilbert curve through the grid is the place
it sorts by. Neighbours on the curve are neighbours in every dimension, so files cut from the sorted run
have narrow bounds in all of them and are skipped by filters on any.

Ranks are exact without a global sort in one task: rows are dealt out by ranges of (index, hash of the
id, id, hash of the text), sorted in their range, and the sizes of the earlier ranges are added. The hash splits
a cell that holds a third of all rows over as many ranges as it fills.

The law is ``rows``: with n rows in curve order, shard s takes ranks ceil(s n / 8) to ceil((s + 1) n / 8) - 1,
so counts are at most one apart.

Defined results: a null text has no bytes (size 1) and checksum 0; null metadata are level 0; rows equal in
all they sort by lie side by side in any order; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill.session import stored

SHARDS, BITS = 8, 8


def hilbert_index(levels: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each cell; one array of levels per dimension.

    Works by the transposed form of the index: bits of the coordinates are exchanged or inverted
    from the highest down, the result is Gray-coded, and the bits are interleaved.
    """
    x = [np.asarray(v).astype(np.int64) for v in levels]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(n):
            set_here = (x[i] & bit) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap if i else x[i]
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ swap)
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> b) & 1, turn ^ ((1 << b) - 1), turn)
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = (index << 1) | (((v ^ turn) >> b) & 1)
    return index


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _number(column: Column, kind: str) -> Column:
    """The value as a number in its own order."""
    if kind != "string":
        return column.cast("double")
    return F.conv(F.rpad(F.hex(F.substring(column.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def in_curve_order(
    docs: DataFrame, id_col: str, text_col: str, dimensions: list[str], columns: list[str], bits: int = BITS
) -> DataFrame:
    """The ``columns`` of every row as ``row``, with ``size``, ``index`` and its exact ``rank`` (from 0) in curve order."""
    kinds = dict(docs.dtypes)
    numbers = [_number(docs[c], kinds[c]) for c in dimensions] + [F.log2(size_of(docs[text_col]))]
    names = [f"_d{i}" for i in range(len(numbers))]
    bounds = docs.select(*[v.alias(c) for v, c in zip(numbers, names)]).agg(
        *[f(c).alias(f"{c}_{k}") for c in names for k, f in (("min", F.min), ("max", F.max))]
    ).first()
    top = (1 << bits) - 1

    def level(value: Column, name: str) -> Column:
        low, high = bounds[f"{name}_min"], bounds[f"{name}_max"]
        if low is None or high == low:
            return F.lit(0)
        return F.coalesce(F.floor((value - low) / (high - low) * top), F.lit(0)).cast("int")

    def index(*levels: pa.Array) -> pa.Array:
        return pa.array(hilbert_index([v.to_numpy(zero_copy_only=False) for v in levels], bits), pa.int64())

    cells = [level(v, c) for v, c in zip(numbers, names)]
    placed = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"), F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text")).alias("tie"),
        size_of(docs[text_col]).alias("size"), F.arrow_udf(index, "bigint")(*cells).alias("index"),
    )
    order = ["index", F.xxhash64("tie.id"), "tie.id", "tie.text"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    runs = stored(dealt.select("row", "size", "index", F.spark_partition_id().alias("_run"), at.alias("_at")), "curve-runs")
    # one row per range, as many as there are shuffle partitions
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("_run").agg(F.count("*").alias("_n")).select(
        "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return runs.join(F.broadcast(starts), "_run").select("row", "size", "index", (F.col("_start") + F.col("_at")).alias("rank"))


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    dimensions: tuple[str, ...] = ("lang", "source", "doc_id"), columns: list[str] | None = None,
) -> DataFrame:
    """``row`` (the ``columns`` of ``docs``; all, if not given), size, index, rank, shard and slot, the place in the shard."""
    ranked = in_curve_order(docs, id_col, text_col, list(dimensions), docs.columns if columns is None else columns)
    n = max(1, docs.count())
    at = F.expr(f"(rank * {shards}) div {n}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", at.cast("int")).withColumn("slot", F.col("rank") - first)

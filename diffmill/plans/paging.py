"""Documents of bounded size.

A review's findings, a job's file metrics or a rebuilt diff are gathered into one
document. Nearly every group is small and gives one row, ``page`` 0. A group
beyond ``page_rows`` is cut into ordered pages over all tasks, so that no task
gathers it whole and nothing of it is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill.session import stored

# Most keys (of a few bytes each) sent to every executor; more are joined by shuffle.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Groups:
    """Rows by the size of their group. ``large`` and ``large_keys`` are None when
    every group fits one page."""

    small: DataFrame
    large: DataFrame | None
    large_keys: DataFrame | None


def attach_by_key(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join that also matches NULL keys."""
    renamed = keys.select([F.col(k).alias(f"_{k}") for k in on])
    same = [rows[k].eqNullSafe(renamed[f"_{k}"]) for k in on]
    return rows.join(renamed, same, how)


def checked_broadcast(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Broadcast ``keys`` if they are few, else leave them to a shuffled join."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def large_keys(sized_by: DataFrame, keys: list[str], page_rows: int) -> DataFrame | None:
    """Keys with more than ``page_rows`` rows, None if there are none.

    The count reads the key columns only and is combined before its shuffle, so a hot
    key costs one row per task.
    """
    large = sized_by.groupBy(*keys).count().where(F.col("count") > page_rows).select(*keys)
    found = large.limit(BROADCAST_KEYS + 1).count()
    if found == 0:
        return None
    large = stored(large, "large-keys")
    return F.broadcast(large) if found <= BROADCAST_KEYS else large


def split_by_size(
    rows: DataFrame, keys: list[str], page_rows: int, sized_by: DataFrame | None = None
) -> Groups:
    """Set oversized groups apart. ``sized_by`` names a cheaper table to count, with at
    least as many rows per key."""
    large = large_keys(rows if sized_by is None else sized_by, keys, page_rows)
    if large is None:
        return Groups(rows, None, None)
    return Groups(
        attach_by_key(rows, large, keys, "left_anti"), attach_by_key(rows, large, keys, "left_semi"), large
    )


def number_pages(rows: DataFrame, keys: list[str], order: list[Column], page_rows: int) -> DataFrame:
    """Add ``page`` to oversized groups: position in the group, divided by ``page_rows``.

    A range shuffle on key and order cuts a group into slices over many tasks, rows are
    numbered within their slice, and the rows of earlier slices are added. The slices
    are drawn from a sample, so they are written down once and read twice.
    """
    sliced = rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = stored(sliced.withColumn("_rank", F.row_number().over(within)), "slices")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranked.groupBy(*keys, "_slice")
        .agg(F.max("_rank").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select([F.col(k).alias(f"_{k}") for k in keys] + [F.col("_slice").alias("_s"), "_start"])
    )
    same = [ranked[k].eqNullSafe(F.col(f"_{k}")) for k in keys] + [ranked["_slice"] == F.col("_s")]
    position = F.col("_start") + F.col("_rank") - 1
    numbered = ranked.join(checked_broadcast(starts), same, "inner")
    return numbered.withColumn("page", F.floor(position / page_rows).cast("bigint")).select(*rows.columns, "page")

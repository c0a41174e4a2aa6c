"""Gapless integer keys for natural keys, from an append-only dictionary (K1).

The dictionary is a table of loads. A load adds the natural keys that no earlier load holds and numbers
them from where the earlier ones end: keys are spread by range, numbered inside their slice, and each slice
starts where the ones before it end. No task sees more than its slice, and only one count per
slice is gathered. A key keeps its number for ever.

A load has a number. Running it again, or again after a failure, writes the same rows: it looks at the
loads before it only, and its numbers follow from the order of the keys, not from how they were cut into slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffmill.plans.paging import checked_broadcast
from diffmill.session import exists, stored


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """All natural keys with their number ``id``."""
    return spark.read.parquet(f"{path}/keys").drop("load")


def extend_dictionary(spark: SparkSession, path: str, keys: DataFrame, load: int) -> None:
    """Give a number to each distinct row of ``keys`` that has none (K1).

    ``load`` numbers the loads from 0, in order. Numbers start with 1 and have no gap.
    Keys with a NULL are keys like others: NULL equals NULL and comes first.
    """
    names = keys.columns
    if not exists(spark, f"{path}/sizes/load={load - 1}") and load > 0:
        raise ValueError(f"load {load} follows load {load - 1}, which is not there")
    fresh, start = keys.distinct(), 0
    if load > 0:
        known = spark.read.parquet(f"{path}/keys").where(F.col("load") < load)
        same = [fresh[c].eqNullSafe(known[c]) for c in names]
        fresh = fresh.join(known, same, "left_anti")
        start = spark.read.parquet(f"{path}/sizes/load={load - 1}").first().total
    added = stored(_numbered(fresh, names, start), "numbered")
    # the sizes come last: a load without them did not finish and runs again
    added.write.mode("overwrite").parquet(f"{path}/keys/load={load}")
    total = added.agg((F.count(F.lit(1)) + start).alias("total"))
    total.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes/load={load}")


def _numbered(fresh: DataFrame, names: list[str], start: int) -> DataFrame:
    """``id`` by order of the keys. Slices come from a sample, so they are written once and read twice."""
    sliced = fresh.repartitionByRange(*names).withColumn("_slice", F.spark_partition_id())
    inside = Window.partitionBy("_slice").orderBy(*names)
    ranked = stored(sliced.withColumn("_rank", F.row_number().over(inside)), "slices")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    starts = (
        ranked.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    placed = ranked.join(checked_broadcast(starts), "_slice")
    return placed.select(*names, (F.col("_start") + F.col("_rank") + start).cast("long").alias("id"))


def with_numbers(rows: DataFrame, dictionary: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """``rows`` with the number of their natural key; NULL where it has none."""
    renamed = dictionary.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("_number"))
    same = [rows[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return rows.join(renamed, same, "left").select(*[rows[c] for c in rows.columns if c != name], F.col("_number").alias(name))

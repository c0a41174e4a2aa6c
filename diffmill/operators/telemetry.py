"""Outcome counters and latency histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.fixed import LATENCY_BOUNDS_MS


def reviews_total(events: DataFrame, by: tuple[str, ...] = ("service", "status")) -> DataFrame:
    """Events per service and outcome (A4)."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("reviews_total"))


def bucket_aggregates(latency: Column) -> list[Column]:
    """Cumulative bucket counts, sum and count, all in one pass (A5)."""
    buckets = [F.count(F.when(latency <= b, 1)).alias(f"le_{b}") for b in LATENCY_BOUNDS_MS]
    return [*buckets, F.sum(latency).alias("latency_sum"), F.count(latency).alias("latency_count")]


def long_buckets(wide: DataFrame, by: list) -> DataFrame:
    """One row per bucket, the last being ``+Inf``."""
    entries = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{b}").alias("n")) for b in LATENCY_BOUNDS_MS]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("latency_count").alias("n")))
    return wide.select(*by, F.explode(F.array(*entries)).alias("b"), "latency_sum", "latency_count").select(
        *by, "b.le", F.col("b.n").alias("bucket_count"), "latency_sum", "latency_count"
    )


def latency_histogram(events: DataFrame, by: tuple[str, ...] = (), latency: str = "latency_ms") -> DataFrame:
    """Cumulative latency buckets with sum and count (A5)."""
    return long_buckets(events.groupBy(*by).agg(*bucket_aggregates(F.col(latency))), list(by))

"""Score trends kept up to date by signed differences (A10).

A trend is a log of partial sums by repository and day. A batch of changed reviews adds what the new rows count and
takes away what the old ones counted, so it costs in proportion to the change and reads nothing of the trend.
A batch has a number and overwrites what it wrote before, so it can run again. Sums of one group are added up when
the trend is read. Months are folders with their rows sorted by day, so that a reader of few days reads little.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.functions.normalize import score_band

BANDS = ("good", "fair", "poor")
_SUMS = ("reviews", "score_sum", *BANDS)
_STORED = "repo string, day date, " + ", ".join(f"{c} long" for c in _SUMS) + ", batch int, month date"


def partial_sums(signed: DataFrame) -> DataFrame:
    """Signed sums by repository and day of reviews with a ``sign`` of 1 or -1; none for those without a score."""
    score, sign = F.col("quality_score"), F.col("sign").cast("long")
    band = score_band(score)
    sums = [F.sum(sign), F.sum(sign * score), *[F.sum(F.when(band == b, sign).otherwise(0)) for b in BANDS]]
    return (
        signed.where(score.isNotNull())
        .groupBy("repo", F.to_date("created_at").alias("day"))
        .agg(*[s.cast("long").alias(c) for s, c in zip(sums, _SUMS)])
        .where(" or ".join(f"{c} <> 0" for c in _SUMS))
    )


def add_batch(path: str, batch: int, new: DataFrame, old: DataFrame | None = None) -> None:
    """Count the ``new`` rows of changed reviews in, and their ``old`` rows out. Both have repo, created_at and
    quality_score; reviews that were added have no old row, deleted ones no new row."""
    columns = ["repo", "created_at", "quality_score"]
    signed = new.select(*columns, F.lit(1).alias("sign"))
    if old is not None:
        signed = signed.unionByName(old.select(*columns, F.lit(-1).alias("sign")))
    _write(partial_sums(signed), f"{path}/batch={batch}")


def _write(sums: DataFrame, path: str) -> None:
    monthly = sums.withColumn("month", F.trunc("day", "month")).hint("rebalance", F.col("month"))
    monthly.sortWithinPartitions("month", "day").write.mode("overwrite").partitionBy("month").parquet(path)


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).option("basePath", path).parquet(path)


def read_trend(
    spark: SparkSession, path: str, grain: str = "day", first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """The rows of ``quality_trend`` over the reviews as the last batch left them, of the days
    from ``first`` to ``last`` if given."""
    log = _log(spark, path)
    if first is not None:
        log = log.where((F.col("month") >= F.lit(first.replace(day=1))) & (F.col("day") >= F.lit(first)))
    if last is not None:
        log = log.where((F.col("month") <= F.lit(last)) & (F.col("day") <= F.lit(last)))
    period = F.date_trunc(grain, F.col("day")).alias("period")
    summed = log.groupBy("repo", period).agg(*[F.sum(c).alias(c) for c in _SUMS]).where("reviews <> 0")
    return summed.select("repo", "period", "reviews", "score_sum", (F.col("score_sum") / F.col("reviews")).alias("mean_score"), *BANDS)


def compact(spark: SparkSession, path: str, into: str) -> None:
    """A new log with one batch that holds the sums of all batches of another."""
    summed = _log(spark, path).groupBy("repo", "day").agg(*[F.sum(c).alias(c) for c in _SUMS])
    kept = summed.where(" or ".join(f"{c} <> 0" for c in _SUMS))
    _write(kept, f"{into}/batch=0")

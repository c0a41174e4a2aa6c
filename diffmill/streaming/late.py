"""Late rows as a side output, and corrections by them.

A watermark makes Spark drop later rows unseen. Here a stream is first split by a clock of its
own: rows in time and late rows go to tables of their own, so that none is lost. Before each
batch the floor is the greatest time of all batches before it less the delay; it is kept
by batch, so a batch that runs again is split in the same way.

Operators with a state read the log of rows in time as their stream. Their watermark has the same delay
and has seen no more than the clock, so it drops none of these rows. The log is
written in a folded form where rows of one key can be combined, which leaves one row of a hot
key in each batch. A batch that runs again rewrites its rows; the folds take repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diffmill.operators.reviews import first_per_job
from diffmill.operators.telemetry import bucket_aggregates, long_buckets
from diffmill.session import exists
from diffmill.streaming.jobs import start_batches

Fold = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Split:
    """Where a split stream is: rows in time, late rows, and the clock."""

    path: str

    @property
    def in_time(self) -> str:
        return f"{self.path}/in_time"

    @property
    def late(self) -> str:
        return f"{self.path}/late"

    @property
    def clock(self) -> str:
        return f"{self.path}/clock"

    def read(self, spark: SparkSession) -> DataFrame:
        return _table(spark, self.in_time)

    def read_late(self, spark: SparkSession) -> DataFrame:
        return _table(spark, self.late)

    def stream(self, spark: SparkSession, **options: str) -> DataFrame:
        """The log of rows in time as a stream."""
        schema = self.read(spark).schema
        return spark.readStream.schema(schema).options(ignoreMissingFiles="true", **options).parquet(f"{self.in_time}/*")


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def split_late(
    stream: DataFrame, path: str, checkpoint: str, delay: str, ts: str = "ts",
    in_time: Fold | None = None, late: Fold | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Split a stream into ``Split(path)``: rows up to ``delay`` behind the greatest time of earlier
    batches are in time; others, and rows without a time, are late. ``in_time`` and ``late`` fold a
    batch's rows before they are written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out, floor = Split(path), _floor(batch.sparkSession, path, batch_id, delay)
        batch = batch.persist()
        try:
            now = batch.agg(F.max(ts).alias("at"))
            before = F.lit(None if floor is None else floor.at).cast("timestamp")
            clock = now.select(F.greatest("at", before).alias("at"))
            fresh = F.coalesce(F.col(ts) >= F.lit(floor.floor) if floor and floor.floor else F.col(ts).isNotNull(), F.lit(False))
            for rows, fold, where in ((batch.where(fresh), in_time, out.in_time), (batch.where(~fresh), late, out.late)):
                folded = fold(rows) if fold else rows
                folded.write.mode("overwrite").parquet(f"{where}/batch_id={batch_id}")
            clock.coalesce(1).write.mode("overwrite").parquet(f"{out.clock}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return start_batches(stream, write, path, checkpoint, "append", trigger)


def _floor(spark: SparkSession, path: str, batch_id: int, delay: str):
    """One row of the batch before: its greatest time ``at``, and ``floor``, the delay before that."""
    last = f"{Split(path).clock}/batch_id={batch_id - 1}"
    if batch_id == 0 or not exists(spark, last):
        return None
    return spark.read.parquet(last).select("at", (F.col("at") - F.expr(f"interval {delay}")).alias("floor")).first()


def end_of_input(spark: SparkSession, split: Split, after: str) -> None:
    """Move the clock of what reads the log to ``after`` behind its last time, by a row of nulls with that
    time. An idle topic needs it, or the last timers never fire."""
    schema = split.read(spark).schema
    last = spark.read.parquet(split.clock).agg((F.max("at") + F.expr(f"interval {after}")).alias("ts"))
    nulls = [F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    last.select(*nulls).coalesce(1).write.mode("overwrite").parquet(f"{split.in_time}/batch_id=-1")


# Windowed counts (ST5, ST6)

def _window(window: str) -> Column:
    return F.window("ts", window)["start"].alias("window_start")


def count_outcomes(window: str) -> Fold:
    """Partial counts by window and status."""
    return lambda rows: rows.groupBy(_window(window), "status").agg(F.count(F.lit(1)).alias("reviews_total"))


def count_latencies(window: str) -> Fold:
    """Partial latency buckets by window."""
    return lambda rows: rows.groupBy(_window(window)).agg(*bucket_aggregates(F.col("latency_ms")))


def stream_windows(
    events: DataFrame, fold: Fold, path: str, checkpoint: str, delay: str, trigger: dict | None = None
) -> StreamingQuery:
    """Partial sums of each batch, those of rows in time and those of late rows apart. They hold no state
    between batches, and a batch that runs again writes the same sums."""
    return split_late(events, path, checkpoint, delay, in_time=fold, late=fold, trigger=trigger)


def windows_in_time(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Sums over what came in time."""
    return _summed(Split(path).read(spark), keys)


def window_corrections(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What late rows add to each window."""
    return _summed(Split(path).read_late(spark), keys)


def corrected_windows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Sums over all rows: those in time, and their corrections."""
    split = Split(path)
    return _summed(split.read(spark).unionByName(split.read_late(spark)), keys)


def _summed(partial: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in partial.columns if c not in keys]
    return partial.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def corrected_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Latency buckets per window over all rows (ST6)."""
    return long_buckets(corrected_windows(spark, path, ["window_start"]), ["window_start"])


# Jobs (ST2)

def corrected_jobs(emitted: DataFrame, late: DataFrame, order: list[str]) -> DataFrame:
    """One row per job over what a deduplicated stream emitted and what came late (ST2): also jobs that
    only came late, and once those that came again after their state was gone."""
    return first_per_job(emitted.unionByName(late), order).drop("deliveries")

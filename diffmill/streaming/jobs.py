"""Streams over deliveries, requests, results and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from diffmill.operators.deliveries import accepted_deliveries, parse_messages, resolve_diff, review_requests, tag_messages
from diffmill.operators.reviews import latest_static
from diffmill.operators.telemetry import bucket_aggregates, long_buckets
from diffmill.session import exists
from diffmill.sources.topics import to_topic


def stream_requests(deliveries: DataFrame, secret: str, landed: DataFrame | None = None) -> DataFrame:
    """Accepted deliveries as request messages (ST1). Stateless.

    The diff is the inline one, else that of ``landed``, a table with one row per repo,
    pr_number and head_sha. What has neither is given by ``undiffed_deliveries``.
    """
    accepted, diff = _with_diff(deliveries, secret, landed)
    return to_topic(review_requests(accepted.where(diff.isNotNull()), diff))


def undiffed_deliveries(deliveries: DataFrame, secret: str, landed: DataFrame | None = None) -> DataFrame:
    """Accepted deliveries for which no diff can be had: their columns and status 500."""
    accepted, diff = _with_diff(deliveries, secret, landed)
    rest = accepted.where(diff.isNull()).drop("_landed")
    return rest.withColumn("status_code", F.lit(500))


def _with_diff(deliveries: DataFrame, secret: str, landed: DataFrame | None) -> tuple[DataFrame, Column]:
    accepted, diff = accepted_deliveries(deliveries, secret), F.col("inline_diff")
    if landed is None:
        return accepted, diff
    keys = ["repo", "pr_number", "head_sha"]
    accepted = accepted.join(landed.select(*keys, F.col("diff").alias("_landed")), keys, "left")
    return accepted, resolve_diff(diff, F.lit(None).cast("string"), F.col("_landed"))


def request_rows(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed fields of the readable messages, with the message time as ``ts``."""
    good, _ = parse_messages(messages, schema)
    return good.withColumnRenamed("timestamp", "ts")


def dedup_jobs(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """One row per job id within ``delay`` (ST2). State holds a key, not the row."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["job_id"])


def stream_apply_static(reviews: DataFrame, results: DataFrame, bound: str) -> DataFrame:
    """Reviews with static results that arrive up to ``bound`` later or earlier (ST3).

    A NULL result means that none came in time. ``reviews`` has job_id and ts,
    ``results`` job_id, static_metrics and ts.
    """
    left = reviews.withWatermark("ts", bound)
    right = results.select(
        F.col("job_id").alias("_job"), "static_metrics", F.col("ts").alias("result_ts")
    ).withWatermark("result_ts", bound)
    span = F.expr(f"interval {bound}")
    near = (F.col("result_ts") >= F.col("ts") - span) & (F.col("result_ts") <= F.col("ts") + span)
    return left.join(right, (F.col("job_id") == F.col("_job")) & near, "left_outer").drop("_job")


def stream_static_log(
    results: DataFrame, path: str, checkpoint: str, order: str = "offset", trigger: dict | None = None
) -> StreamingQuery:
    """Log of static results with one row per job and micro-batch (ST3, ST8).

    The other way to bring results to reviews: ``apply_static`` folds the log when it is
    read. A job that repeats without end is reduced in every task before the shuffle,
    which a join of streams cannot do.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_static(batch, order).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start_batches(results, write, path, checkpoint, "append", trigger)


def stream_counters(events: DataFrame, window: str, delay: str) -> DataFrame:
    """Outcomes per window and status (ST5)."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("reviews_total"))
        .select(F.col("w.start").alias("window_start"), "status", "reviews_total")
    )


def stream_histogram(events: DataFrame, window: str, delay: str) -> DataFrame:
    """Latency buckets per window (ST6)."""
    wide = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(*bucket_aggregates(F.col("latency_ms")))
        .withColumn("window_start", F.col("w.start"))
    )
    return long_buckets(wide, ["window_start"])


def write_stream(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None
) -> StreamingQuery:
    """Replay-safe table write (ST8): each micro-batch overwrites its own directory, so
    a batch that runs again after a failure leaves one copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start_batches(df, write, path, checkpoint, mode, trigger)


def stream_quarantine(
    messages: DataFrame, schema: T.StructType, good: str, quarantine: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Readable and unusable messages to their own tables (ST7). A batch is parsed once
    and both writers read what was kept of it."""
    names = [f.name for f in schema.fields]
    kept = [c for c in messages.columns if c not in names and c != "value"]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            fine = batch.where(F.col("reason").isNull()).select(*kept, *[f"_msg.{n}" for n in names])
            fine.write.mode("overwrite").parquet(f"{good}/batch_id={batch_id}")
            rest = batch.where(F.col("reason").isNotNull()).drop("_msg")
            rest.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return start_batches(tag_messages(messages, schema), write, good, checkpoint, "append", trigger)


def start_batches(
    df: DataFrame, write: Callable[[DataFrame, int], None], path: str, checkpoint: str, mode: str, trigger: dict | None
) -> StreamingQuery:
    """Start a stream that writes each batch to a directory of ``path`` by its number (ST8).

    A new checkpoint numbers its batches from 0 again and would overwrite those of an
    earlier one, so it is refused where ``path`` is there already.
    """
    if exists(df.sparkSession, path) and not exists(df.sparkSession, f"{checkpoint}/metadata"):
        raise ValueError(f"{path} holds batches of another checkpoint than {checkpoint}")
    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_rows(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """Table of an update-mode stream: the row of the last batch per key."""
    newest = F.max_by(F.struct(*values), "batch_id").alias("_v")
    return spark.read.parquet(path).groupBy(*keys).agg(newest).select(*keys, "_v.*")

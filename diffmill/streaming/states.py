"""Streams with a state of their own: reviews as state machines, and static results joined to reviews.

Both read the log of rows in time of a split stream (``late``), folded to one row of a key and
batch, so a hot key sends one row to its task. State lies in RocksDB, off the heap. Timers of
event time bound it: what is finished, abandoned or out of reach leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState

from diffmill.fixed import FINISHED
from diffmill.streaming.jobs import write_stream
from diffmill.streaming.late import split_late

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of jobs by which reviews and results are held.
JOB_BUCKETS = 1024


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which processors with timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def milliseconds(interval: str) -> int:
    """Length of an interval like ``2 days``."""
    units = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    number, unit = interval.split()
    return int(number) * units[unit.removesuffix("s")]


# Review state (ST4)

STATE_COLUMNS = ["created_at", "status", "ts", "seq"]


def fold_states(events: DataFrame) -> DataFrame:
    """First time, and status, time and number of the last event of each job. Folding folded rows
    again gives the same, in any order and however often."""
    created = "created_at" if "created_at" in events.columns else "ts"
    last = F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("_last")
    return events.groupBy("job_id").agg(F.min(created).alias("created_at"), last).select("job_id", "created_at", "_last.*")


def split_states(events: DataFrame, path: str, checkpoint: str, delay: str, trigger: dict | None = None) -> StreamingQuery:
    """Review events (job_id, status, ts, seq) in time, folded, and late ones as they came."""
    rows = events.select("job_id", "status", "ts", "seq")
    return split_late(rows, path, checkpoint, delay, in_time=fold_states, trigger=trigger)


class ReviewStates(StatefulProcessor):
    """State of a job: first time, and status, time and number of its last event. A job leaves it
    ``keep`` after it is finished and ``abandon`` after its last event otherwise."""

    def __init__(self, keep: str, abandon: str):
        self.keep, self.abandon = milliseconds(keep), milliseconds(abandon)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("review", "created long, status string, at long, seq long, leaves long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        created, last, leaves = (held[0], (held[2], held[3], held[1]), held[4]) if held else (None, None, None)
        for row in rows:
            if row.job_id is None or row.at is None:
                continue
            created = row.created if created is None else min(created, row.created)
            this = (row.at, row.seq, row.status)
            last = this if last is None or this[:2] > last[:2] else last
        if last is None:
            return
        at, seq, status = last
        due = at // 1000 + (self.keep if status in FINISHED else self.abandon)
        if due != leaves:
            if leaves is not None:
                self.handle.deleteTimer(leaves)
            self.handle.registerTimer(due)
        self.state.update((created, status, at, seq, due))
        yield Row(job_id=key[0], created=created, status=status, at=at, seq=seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def review_states(folded: DataFrame, delay: str, keep: str = "1 day", abandon: str = "30 days") -> DataFrame:
    """State of each job after each of its batches (ST4), from a stream of folded events.

    A job that comes again after it left the state begins anew; ``final_states`` folds all its rows.
    """
    micros = {"created": F.unix_micros("created_at"), "at": F.unix_micros("ts")}
    changed = (
        folded.withWatermark("ts", delay)
        .withColumns(micros)
        .groupBy("job_id")
        .transformWithState(
            ReviewStates(keep, abandon), "job_id string, created long, status string, at long, seq long", "Update", "EventTime"
        )
    )
    return changed.select(
        "job_id", F.timestamp_micros("created").alias("created_at"), "status", F.timestamp_micros("at").alias("ts"), "seq"
    )


def final_states(emitted: DataFrame, late: DataFrame | None = None) -> DataFrame:
    """Last state of each job over all that a stream emitted and what came late: the rows of
    ``review_state`` over all events."""
    rows = emitted.select("job_id", *STATE_COLUMNS)
    if late is not None:
        rows = rows.unionByName(late.select("job_id", F.col("ts").alias("created_at"), "status", "ts", "seq"))
    done = F.when(F.col("status") == "done", F.col("ts")).alias("completed_at")
    return fold_states(rows).select("job_id", "created_at", "status", done)


# Reviews with their static results (ST3)

def both_sides(reviews: DataFrame, results: DataFrame, grain: str, order: str = "offset") -> DataFrame:
    """Reviews (job_id, ts) and results (job_id, static_metrics, ts, ``order``) as one stream."""
    none = F.lit(None)
    left = reviews.select(
        "job_id", F.lit("review").alias("kind"), "ts", none.cast("timestamp").alias("grain"),
        none.cast("long").alias("result_offset"), none.cast("string").alias("static_metrics"),
    )
    size = milliseconds(grain)
    floor = F.timestamp_millis(F.floor(F.unix_millis("ts") / size).cast("long") * size)
    right = results.select(
        "job_id", F.lit("result").alias("kind"), "ts", floor.alias("grain"),
        F.col(order).cast("long").alias("result_offset"), "static_metrics",
    )
    return left.unionByName(right)


def fold_sides(rows: DataFrame) -> DataFrame:
    """One row per review, and the last result of each job and grain."""
    return (
        rows.groupBy("job_id", "kind", "grain")
        .agg(
            F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.max("result_offset").alias("result_offset"),
            F.max_by("static_metrics", "result_offset").alias("static_metrics"),
        )
        .withColumn("ts", F.when(F.col("kind") == "review", F.col("_first")).otherwise(F.col("_last")))
        .select("job_id", "kind", "ts", "grain", "result_offset", "static_metrics")
    )


def split_sides(
    reviews: DataFrame, results: DataFrame, path: str, checkpoint: str, delay: str, grain: str, order: str = "offset",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Both sides by one clock: rows in time, folded, and late ones as they came."""
    rows = both_sides(reviews, results, grain, order)
    return split_late(rows, path, checkpoint, delay, in_time=fold_sides, trigger=trigger)


class StaticJoin(StatefulProcessor):
    """Holds the results of a bucket of jobs by grain and its reviews until they close.

    A review at t closes at the end of the grain that t + bound lies in (or begins), and takes the last result of
    the grains from that of t - bound up to there. When the watermark reaches the close, it is emitted, with or
    without a result, and a repeated one is ignored for another bound.

    Every call of a state is a round trip, so there are a few of them per bucket and batch and none per job. A batch's rows
    are appended unread, as columns; the one timer of a bucket stands at the first time at which something closes or
    leaves, and all that is due is then found at once.
    """

    def __init__(self, bound: str, grain: str):
        self.bound, self.grain = milliseconds(bound), milliseconds(grain)

    def init(self, handle) -> None:
        self.handle = handle
        self.review = handle.getListState("review", "job_id array<string>, at array<bigint>, emitted array<boolean>")
        self.results = handle.getListState(
            "results", "job_id array<string>, grain array<bigint>, result_offset array<bigint>, static_metrics array<string>"
        )
        self.due = handle.getValueState("due", "at bigint")

    def _close(self, at: pd.Series) -> pd.Series:
        return -(-(at // 1000 + self.bound) // self.grain) * self.grain

    def _leaves(self, grain: pd.Series) -> pd.Series:
        return grain + 2 * (self.bound + self.grain)

    def _ends(self, reviews: pd.DataFrame) -> pd.Series:
        """When a review closes or, once emitted, is forgotten."""
        return self._close(reviews["at"]) + reviews["emitted"] * self.bound

    def _wake(self, reviews: pd.DataFrame, results: pd.DataFrame, held: int | None) -> None:
        """The timer of a bucket that now stands at ``held`` to when the first of these rows is due, if that is earlier."""
        times = [times.min() for times in (self._ends(reviews), self._leaves(results["grain"])) if len(times)]
        first = min(map(int, times), default=None)
        if first is not None and (held is None or first < held):
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(first)
            self.due.update((first,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["known"]]
            is_review = frame["is_review"].to_numpy(bool)
            reviews = frame.loc[is_review, ["job_id", "time"]].set_axis(_REVIEW[:2], axis=1).assign(emitted=False)
            results = frame.loc[~is_review, ["job_id", "time", "result_offset", "static_metrics"]].set_axis(_RESULT, axis=1)
            for state, new in ((self.review, reviews), (self.results, results)):
                if len(new):
                    state.appendValue(_columns(new))
            if len(frame):
                held = self.due.get()
                self._wake(reviews, results, held[0] if held else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        reviews, results = _frame(self.review, _REVIEW), _frame(self.results, _RESULT)
        # An emitted review, else the earliest one of a job; the last result of a job and grain, of equal ones the first.
        reviews = reviews.sort_values(["emitted", "at"], ascending=[False, True], kind="stable").drop_duplicates("job_id")
        results = results.sort_values("result_offset", ascending=False, kind="stable").drop_duplicates(["job_id", "grain"])
        closed = ~reviews["emitted"] & (self._close(reviews["at"]) <= now)
        joined = self._joined(reviews[closed], results)
        reviews = reviews.assign(emitted=reviews["emitted"] | closed)
        reviews = reviews[self._ends(reviews) > now]
        results = results[self._leaves(results["grain"]) > now]
        for state, left in ((self.review, reviews), (self.results, results)):
            if len(left):
                state.put([_columns(left)])
            else:
                state.clear()
        self.due.clear()
        self._wake(reviews, results, None)
        return iter([joined] if len(joined) else ())

    def _joined(self, reviews: pd.DataFrame, results: pd.DataFrame) -> pd.DataFrame:
        """Reviews with their last result of the grains in reach, ``results`` falling by offset."""
        first = (reviews["at"] // 1000 - self.bound) // self.grain * self.grain
        spans = reviews.assign(first=first, close=self._close(reviews["at"]))[["job_id", "first", "close"]]
        near = results.merge(spans, on="job_id")
        near = near[(near["first"] <= near["grain"]) & (near["grain"] < near["close"])].drop_duplicates("job_id")
        # A type with NULL before the left join, which would make floats of the numbers.
        near = near[["job_id", "static_metrics", "result_offset"]].astype({"result_offset": "Int64"})
        return reviews[["job_id", "at"]].merge(near, on="job_id", how="left")

    def close(self) -> None:
        pass


_REVIEW, _RESULT = ["job_id", "at", "emitted"], ["job_id", "grain", "result_offset", "static_metrics"]
_KINDS = {"job_id": object, "static_metrics": object, "emitted": bool}


def _columns(frame: pd.DataFrame) -> tuple[list, ...]:
    return tuple(frame[c].tolist() for c in frame.columns)


def _frame(state: ListState, names: list[str]) -> pd.DataFrame:
    """All rows of a state of columns, in the order in which they came."""
    parts = list(state.get())
    columns = {name: list(chain.from_iterable(part[i] for part in parts)) for i, name in enumerate(names)}
    return pd.DataFrame({name: pd.Series(values, dtype=_KINDS.get(name, "int64")) for name, values in columns.items()})


def stream_static_outer(sides: DataFrame, delay: str, bound: str, grain: str, buckets: int = JOB_BUCKETS) -> DataFrame:
    """Every review once, with its last static result or NULL (ST3), from a stream of folded sides.

    Rows come when the watermark passes the review's close. State holds a job for three bounds or so, and is kept by
    ``buckets`` of jobs. A task holds one bucket at a time, so choose more for a larger state; a checkpoint keeps its number.
    """
    is_review = F.coalesce(F.col("kind") == "review", F.lit(False))
    time = F.when(is_review, F.unix_micros("ts")).otherwise(F.unix_millis("grain"))
    # Whole numbers without NULL, which pandas would read as floats.
    sides = sides.withWatermark("ts", delay).select(
        "ts", "job_id", "static_metrics", is_review.alias("is_review"), F.coalesce(time, F.lit(0)).alias("time"),
        F.coalesce("result_offset", F.lit(-(2**63))).alias("result_offset"),
        (F.col("job_id").isNotNull() & time.isNotNull()).alias("known"),
        F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"),
    )
    joined = sides.groupBy("bucket").transformWithStateInPandas(
        StaticJoin(bound, grain), "job_id string, at long, static_metrics string, result_offset long", "Append", "EventTime"
    )
    return joined.select("job_id", F.timestamp_micros("at").alias("ts"), "static_metrics", "result_offset")


def write_states(df: DataFrame, path: str, checkpoint: str, mode: str, trigger: dict | None = None) -> StreamingQuery:
    """``write_stream`` for streams with a processor."""
    with rocksdb_state(df.sparkSession):
        return write_stream(df, path, checkpoint, mode, trigger)

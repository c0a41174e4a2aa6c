"""Split streams, corrections, and streams with a state, against batch forms and plain readings."""

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from diffmill.operators import reviews
from diffmill.session import work_dir
from diffmill.streaming import jobs, late, states

DAY0 = dt.datetime(2024, 1, 1)
EVENTS = "job_id string, status string, ts timestamp, seq long"


def at(hours):
    return DAY0 + dt.timedelta(hours=hours)


@pytest.fixture
def folder(spark):
    return work_dir(spark, "states")


def feed(spark, folder, schema, batches, start):
    """Land each batch and run a stream over the folder after it."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(schema).parquet(f"{folder}/in")).awaitTermination()


def plain_split(batches, delay, time=lambda r: r[2]):
    """Rows in time and late ones by the rule: a delay behind the greatest time of earlier batches."""
    fresh, stale, clock = [], [], None
    for rows in batches:
        for r in rows:
            t = time(r)
            (stale if t is None or clock is not None and t < clock - delay else fresh).append(r)
        clock = max([time(r) for r in rows if time(r) is not None] + ([clock] if clock else []), default=None)
    return fresh, stale


def random_events(seed, n_batches=5, n=60, spread=30):
    rng = random.Random(seed)
    out, seq = [], 0
    for b in range(n_batches):
        rows = []
        for _ in range(n):
            seq += 1
            hour = b * 24 + rng.choice([0, 0, 0, -spread, -3 * spread]) + rng.random() * 20
            rows.append((f"j{rng.randrange(25)}", rng.choice(["pending", "running", "done", "failed"]), at(hour), seq))
        out.append(rows)
    return out


def test_split_lists_every_late_row(spark, folder):
    batches = random_events(1)
    batches[2].append(("j1", "done", None, 999))
    feed(spark, folder, EVENTS, batches, lambda s: late.split_late(s, f"{folder}/split", f"{folder}/cp", "1 day"))
    split = late.Split(f"{folder}/split")
    fresh, stale = plain_split(batches, dt.timedelta(days=1))
    assert sorted(map(tuple, split.read(spark).collect()), key=lambda r: r[3]) == sorted(fresh, key=lambda r: r[3])
    assert sorted(map(tuple, split.read_late(spark).collect()), key=lambda r: r[3]) == sorted(stale, key=lambda r: r[3])
    assert len(stale) > 20


def test_corrected_windows_equal_the_batch(spark, folder):
    batches = random_events(2)
    fold = late.count_outcomes("1 day")
    feed(spark, folder, EVENTS, batches, lambda s: late.stream_windows(s, fold, f"{folder}/w", f"{folder}/cp", "1 day"))
    keys = ["window_start", "status"]
    want = {}
    for r in sum(batches, []):
        key = (r[2].replace(hour=0, minute=0, second=0, microsecond=0), r[1])
        want[key] = want.get(key, 0) + 1
    got = {tuple(r)[:2]: r.reviews_total for r in late.corrected_windows(spark, f"{folder}/w", keys).select(*keys, "reviews_total").collect()}
    assert got == want
    in_time, more = (sum(r.reviews_total for r in f(spark, f"{folder}/w", keys).collect()) for f in (late.windows_in_time, late.window_corrections))
    fresh, stale = plain_split(batches, dt.timedelta(days=1))
    assert (in_time, more) == (len(fresh), len(stale))


def test_corrected_histogram_equals_the_batch(spark, folder):
    rng = random.Random(3)
    schema = "latency_ms int, ts timestamp"
    batches = [[(rng.randrange(40_000), at(24 * b + rng.randrange(-60, 24))) for _ in range(40)] for b in range(4)]
    fold = late.count_latencies("1 day")
    feed(spark, folder, schema, batches, lambda s: late.stream_windows(s, fold, f"{folder}/w", f"{folder}/cp", "1 day"))
    rows = late.corrected_histogram(spark, f"{folder}/w").collect()
    for r in rows:
        inside = [ms for ms, t in sum(batches, []) if r.window_start <= t < r.window_start + dt.timedelta(days=1)]
        bound = float("inf") if r.le == "+Inf" else int(r.le)
        assert (r.bucket_count, r.latency_sum, r.latency_count) == (sum(x <= bound for x in inside), sum(inside), len(inside))
    assert len(rows) == 8 * len({t.date() for _, t in sum(batches, [])})


def test_jobs_that_only_came_late_are_added(spark, folder):
    batches = random_events(4)
    batches[3].append(("only-late", "done", at(0), 5000))
    split = late.Split(f"{folder}/split")

    def start(stream):
        late.split_late(stream, split.path, f"{folder}/cp", "1 day").awaitTermination()
        return jobs.write_stream(jobs.dedup_jobs(split.stream(spark), "1 day"), f"{folder}/out", f"{folder}/cp2")

    feed(spark, folder, EVENTS, batches, start)
    emitted = spark.read.parquet(f"{folder}/out").select(*[c.split()[0] for c in EVENTS.split(", ")])
    assert emitted.where("job_id = 'only-late'").count() == 0
    got = late.corrected_jobs(emitted, split.read_late(spark), ["ts", "seq"])
    assert sorted(r.job_id for r in got.collect()) == sorted({r[0] for r in sum(batches, [])})


def state_run(spark, folder, batches, keep, abandon):
    split = late.Split(f"{folder}/split")

    def start(stream):
        states.split_states(stream, split.path, f"{folder}/cp", "1 day").awaitTermination()
        changed = states.review_states(split.stream(spark), "1 day", keep, abandon)
        return states.write_states(changed, f"{folder}/out", f"{folder}/cp2", "update")

    feed(spark, folder, EVENTS, batches, start)
    return spark.read.parquet(f"{folder}/out"), split.read_late(spark)


def test_review_states_equal_the_batch_fold(spark, folder):
    batches = random_events(5)
    emitted, stale = state_run(spark, folder, batches, "2 hours", "3 days")
    columns = ["job_id", "created_at", "status", "completed_at"]
    want = reviews.review_state(spark.createDataFrame(sum(batches, []), EVENTS)).select(columns)
    assert sorted(states.final_states(emitted, stale).select(columns).collect()) == sorted(want.collect())
    assert stale.count() == len(plain_split(batches, dt.timedelta(days=1))[1]) > 0


def test_finished_and_abandoned_jobs_leave_the_state(spark, folder):
    batches = [
        [("done", "running", at(0), 1), ("open", "running", at(1), 2), ("old", "pending", at(1), 3)],
        [("done", "done", at(2), 4), ("open", "running", at(80), 5)],
        [("other", "running", at(100), 6)],
    ]
    state_run(spark, folder, batches, "1 hour", "2 days")
    held = spark.read.format("statestore").option("stateVarName", "review").load(f"{folder}/cp2")
    assert sorted(r[0] for r in held.select("key.job_id").collect()) == ["open", "other"]


REVIEWS, RESULTS = "job_id string, ts timestamp", "job_id string, static_metrics string, ts timestamp, offset long"
HOUR = dt.timedelta(hours=1)


def plain_join(opened, results, bound, grain):
    """By the rule: the last result from the grain of t - bound up to the close, or none."""
    def floor(t):
        return DAY0 + (t - DAY0) // grain * grain

    out = {}
    for job, t in opened:
        close = floor(t + bound) if floor(t + bound) == t + bound else floor(t + bound) + grain
        near = [r for r in results if r[0] == job and floor(t - bound) <= r[2] < close]
        out[job] = max(near, key=lambda r: r[3])[1] if near else None
    return out


@pytest.mark.parametrize("seed", [6, 7])
def test_every_review_once_with_or_without_its_result(spark, folder, seed):
    rng = random.Random(seed)
    opened, results = [], []
    for i in range(60):
        hour = rng.randrange(0, 160)
        opened.append((f"j{i}", at(hour)))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            results.append((f"j{i}", f"m{len(results)}", at(hour + rng.randrange(-30, 31)), len(results)))
    results += [("nobody", f"x{k}", at(k % 150), 10_000 + k) for k in range(300)]
    split = late.Split(f"{folder}/split")
    for low in range(-40, 200, 60):
        inside = lambda t: at(low) <= t < at(low + 60)
        spark.createDataFrame([r for r in opened if inside(r[1])], REVIEWS).write.mode("append").parquet(f"{folder}/a")
        spark.createDataFrame([r for r in results if inside(r[2])], RESULTS).write.mode("append").parquet(f"{folder}/b")
        left = spark.readStream.schema(REVIEWS).parquet(f"{folder}/a")
        right = spark.readStream.schema(RESULTS).parquet(f"{folder}/b")
        states.split_sides(left, right, split.path, f"{folder}/cp", "3 days", "4 hours").awaitTermination()
        joined = states.stream_static_outer(split.stream(spark), "3 days", "12 hours", "4 hours")
        states.write_states(joined, f"{folder}/out", f"{folder}/cp2", "append").awaitTermination()
    late.end_of_input(spark, split, "10 days")
    joined = states.stream_static_outer(split.stream(spark), "3 days", "12 hours", "4 hours")
    states.write_states(joined, f"{folder}/out", f"{folder}/cp2", "append").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    want = plain_join(opened, results, 12 * HOUR, 4 * HOUR)
    assert len(rows) == len(opened) and {r.job_id: r.static_metrics for r in rows} == want
    assert any(v is None for v in want.values()) and sum(v is not None for v in want.values()) > 15
    assert split.read_late(spark).count() == 0
    # results of a job cost a row per grain and batch, however many there are
    folded = split.read(spark).where("job_id = 'nobody'").groupBy("grain").count()
    assert folded.agg(F.max("count")).first()[0] == 1
    held = spark.read.format("statestore").option("stateVarName", "review").load(f"{folder}/cp2")
    assert held.count() == 0


def test_repeated_reviews_are_emitted_once(spark, folder):
    split = late.Split(f"{folder}/split")
    rows = [("a", at(0)), ("a", at(3)), ("a", at(0))]
    spark.createDataFrame(rows, REVIEWS).write.parquet(f"{folder}/a")
    spark.createDataFrame([("a", "m", at(1), 1)], RESULTS).write.parquet(f"{folder}/b")
    left, right = (spark.readStream.schema(s).parquet(f"{folder}/{x}") for s, x in ((REVIEWS, "a"), (RESULTS, "b")))
    states.split_sides(left, right, split.path, f"{folder}/cp", "1 day", "1 hour").awaitTermination()
    late.end_of_input(spark, split, "3 days")
    joined = states.stream_static_outer(split.stream(spark), "1 day", "2 hours", "1 hour")
    states.write_states(joined, f"{folder}/out", f"{folder}/cp2", "append").awaitTermination()
    assert [(r.job_id, r.ts, r.static_metrics) for r in spark.read.parquet(f"{folder}/out").collect()] == [("a", at(0), "m")]


class Cells:
    """A state or a handle that keeps its cells in memory and counts the calls."""

    def __init__(self):
        self.cells, self.timers, self.calls = [], set(), 0

    def get(self):
        self.calls += 1
        return iter(list(self.cells))

    def appendValue(self, value):
        self.put([*self.cells, value])

    def put(self, values):
        self.calls += 1
        self.cells = list(values)

    def clear(self):
        self.put([])

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Value(Cells):
    def get(self):
        return next(super().get(), None)

    def update(self, value):
        self.put([value])


def test_calls_of_the_static_join_do_not_grow_with_its_jobs():
    """Each call is a round trip between Python and the JVM, which made the join slow."""
    counted = []
    for jobs_held in (10, 2000):
        made = []
        handle = Cells()
        handle.getListState = lambda *_: made.append(Cells()) or made[-1]  # noqa: B023
        handle.getValueState = lambda *_: made.append(Value()) or made[-1]  # noqa: B023
        join = states.StaticJoin("2 hours", "1 hour")
        join.init(handle)
        hour, out = 3_600_000, []

        def batch(rows, watermark):
            columns = ["job_id", "is_review", "time", "result_offset", "static_metrics"]
            clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
            join.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns).assign(known=True)]), clock)  # noqa: B023
            for due in [t for t in handle.timers if t <= watermark]:  # noqa: B023
                handle.timers.discard(due)  # noqa: B023
                for frame in join.handleExpiredTimer((0,), clock, None):  # noqa: B023
                    out.extend(frame.itertuples(index=False, name=None))  # noqa: B023

        names = [f"j{i}" for i in range(jobs_held)]
        batch([(n, True, 5 * hour * 1000, -1, None) for n in names], 0)
        batch([(n, False, 6 * hour, 2**60 + i, f"m{i}") for i, n in enumerate(names[1:])], 0)
        batch([(n, True, 4 * hour * 1000, -1, None) for n in names[:2]], hour)
        batch([("other", False, 20 * hour, 1, "x")], 7 * hour)
        batch([(n, True, 8 * hour * 1000, -1, None) for n in names[:2]], 8 * hour)
        batch([("other", False, 20 * hour, 2, "y")], 40 * hour)
        want = {n: (5 * hour * 1000, f"m{i}", 2**60 + i) for i, n in enumerate(names[1:])}
        want[names[0]] = (4 * hour * 1000, None, None)
        # The earlier time of j1 closes at the grain of its result, which is then too late.
        want[names[1]] = (4 * hour * 1000, None, None)
        got = {r[0]: tuple(None if pd.isna(x) else x for x in r[1:]) for r in out}
        assert len(out) == jobs_held and got == want
        assert all(not state.cells for state in made) and not handle.timers
        counted.append(handle.calls + sum(state.calls for state in made))
    assert counted[0] == counted[1] < 50

"""Streams over folders that grow between runs, compared with their batch forms."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from diffmill.operators import reviews
from diffmill.operators.deliveries import accepted_deliveries, extract_pr
from diffmill.plans import views as V
from diffmill.schemas import DELIVERY, REQUEST
from diffmill.session import work_dir
from diffmill.sources import topics
from diffmill.sources.deliveries import read_deliveries
from diffmill.streaming import jobs

DAY0 = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY0 + dt.timedelta(hours=hours)


@pytest.fixture
def folder(spark):
    return work_dir(spark, "test")


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(df, folder, mode="append"):
    jobs.write_stream(df, f"{folder}/table", f"{folder}/checkpoint", mode).awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/table")


SEEN = "job_id string, n int, ts timestamp"


def test_dedup_across_batches(spark, folder):
    source = f"{folder}/in"
    land(spark, source, [("a", 1, at(0)), ("a", 2, at(1)), ("b", 3, at(1))], SEEN)
    stream = jobs.dedup_jobs(spark.readStream.schema(SEEN).parquet(source), "1 day")
    run(stream, folder)
    land(spark, source, [("a", 4, at(2)), ("c", 5, at(3))], SEEN)
    stream = jobs.dedup_jobs(spark.readStream.schema(SEEN).parquet(source), "1 day")
    got = run(stream, folder)
    assert sorted(r.job_id for r in got.collect()) == ["a", "b", "c"]


def test_static_join_reports_what_never_came(spark, folder):
    opened, results = f"{folder}/opened", f"{folder}/results"
    land(spark, opened, [("a", 1, at(0)), ("b", 2, at(0)), ("c", 3, at(30))], SEEN)
    land(spark, results, [("a", "m", at(1))], "job_id string, static_metrics string, ts timestamp")

    def joined():
        return jobs.stream_apply_static(
            spark.readStream.schema(SEEN).parquet(opened),
            spark.readStream.schema("job_id string, static_metrics string, ts timestamp").parquet(results),
            "2 hours",
        )

    first = run(joined(), folder).select("job_id", "static_metrics")
    assert [tuple(r) for r in first.collect()] == [("a", "m")]
    land(spark, opened, [("d", 4, at(200))], SEEN)
    land(spark, results, [("z", "x", at(200))], "job_id string, static_metrics string, ts timestamp")
    got = run(joined(), folder).select("job_id", "static_metrics")
    assert sorted(map(tuple, got.collect())) == [("a", "m"), ("b", None), ("c", None)]


def test_static_log_folds_to_the_last_result(spark, folder):
    source, schema = f"{folder}/in", "job_id string, static_metrics string, offset long"
    log, opened = f"{folder}/log", spark.createDataFrame([(1, "a", None), (2, "b", "old")], "id long, job_id string, static_metrics string")
    for part in ([("a", "m1", 1), ("a", "m3", 3), ("x", "m2", 2)], [("a", "m0", 0), ("b", "m4", 4)]):
        land(spark, source, part, schema)
        jobs.stream_static_log(spark.readStream.schema(schema).parquet(source), log, f"{folder}/checkpoint").awaitTermination()
    assert spark.read.parquet(log).count() == 4
    updated, unmatched = reviews.apply_static(opened, spark.read.parquet(log), "offset")
    assert sorted(map(tuple, updated.select("id", "static_metrics").collect())) == [(1, "m3"), (2, "m4")]
    assert [r.job_id for r in unmatched.collect()] == ["x"]


def test_counters_update_over_batches(spark, folder):
    source, schema = f"{folder}/in", "status string, ts timestamp"
    for hours in ([1, 2, 26], [3, 27]):
        land(spark, source, [("done", at(h)) for h in hours], schema)
        counted = jobs.stream_counters(spark.readStream.schema(schema).parquet(source), "1 day", "2 days")
        run(counted, folder, "update")
    got = jobs.latest_rows(spark, f"{folder}/table", ["window_start", "status"], ["reviews_total"])
    assert sorted(map(tuple, got.collect())) == [(at(0), "done", 3), (at(24), "done", 2)]


def test_review_state_equals_batch(spark, folder):
    schema = "job_id string, status string, ts timestamp, seq long"
    log = [
        ("a", "pending", at(0), 0), ("a", "running", at(1), 1), ("b", "running", at(1), 2), ("a", "done", at(2), 3),
        ("b", "failed", at(2), 4), ("c", "done", at(2), 5), ("c", "failed", at(2), 6),
    ]
    source = f"{folder}/in"
    for part in (log[:3], log[3:]):
        land(spark, source, part, schema)
        run(reviews.review_state(spark.readStream.schema(schema).parquet(source)), folder, "update")
    columns = ["job_id", "created_at", "status", "completed_at"]
    streamed = jobs.latest_rows(spark, f"{folder}/table", ["job_id"], columns[1:]).select(columns)
    batch = reviews.review_state(spark.createDataFrame(log, schema)).select(columns)
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert sorted(batch.collect())[0] == ("a", at(0), "done", at(2))
    assert {r.job_id: r.completed_at for r in batch.collect()}["c"] is None


def test_quarantine(spark, folder):
    source = f"{folder}/in"
    schema = "key string, value string, partition int, offset long, timestamp timestamp"
    values = ['{"job_id": "a", "pr_number": 1}', "", "{bad", None]
    land(spark, source, [("k", x, 0, i, at(0)) for i, x in enumerate(values)], schema)
    messages = topics.read_requests(spark, path=source)
    good, bad = f"{folder}/good", f"{folder}/bad"
    jobs.stream_quarantine(messages, REQUEST, good, bad, f"{folder}/checkpoint").awaitTermination()
    fine = spark.read.parquet(good).select("offset", "job_id", "pr_number")
    assert [tuple(r) for r in fine.collect()] == [(0, "a", 1)]
    reasons = dict(spark.read.parquet(bad).select("offset", "reason").collect())
    assert reasons == {1: "blank", 2: "malformed", 3: "blank"}
    assert spark.read.parquet(bad).where("reason = 'malformed'").first().value == "{bad"


def test_requests_from_landed_deliveries(spark, folder):
    source = f"{folder}/in"
    sent = V.deliveries(V.table(spark, "/root/testdata/sf0.001", "events")).select(DELIVERY.fieldNames())
    sent.write.json(source)
    got = run(jobs.stream_requests(read_deliveries(spark, source, stream=True), V.SECRET), folder)
    batch = read_deliveries(spark, source)
    assert batch.count() == sent.count()
    for r in got.collect():
        message = json.loads(r.value)
        assert message["job_id"] == r.key and message["diff"] == "+x"
    assert got.count() == got.select("key").distinct().count() > 0
    typed = jobs.request_rows(got.withColumn("timestamp", F.lit(at(0))), REQUEST)
    assert typed.where("pr_number is null or ts is null").count() == 0


def test_requests_take_landed_diffs(spark, folder):
    source = f"{folder}/in"
    sent = V.deliveries(V.table(spark, "/root/testdata/sf0.001", "events")).select(DELIVERY.fieldNames())
    sent.write.json(source)
    wanted = extract_pr(accepted_deliveries(sent, V.SECRET).select(DELIVERY.fieldNames()))
    keys = wanted.select("repo", "pr_number", "head_sha").distinct()
    landed = keys.where("pr_number % 2 = 0").withColumn("diff", F.lit("landed"))
    got = run(jobs.stream_requests(read_deliveries(spark, source, stream=True), V.SECRET, landed), folder)
    counts = {}
    for r in got.collect():
        diff = json.loads(r.value)["diff"]
        counts[diff] = counts.get(diff, 0) + 1
    inline = F.col("inline_diff").isNotNull()
    assert counts == {
        "+x": wanted.where(inline).count(), "landed": wanted.where(~inline & (F.col("pr_number") % 2 == 0)).count()
    }


def test_a_repeated_batch_leaves_one_copy(spark, folder):
    source, table = f"{folder}/in", f"{folder}/table"
    land(spark, source, [("a", 1, at(0))], SEEN)
    stream = spark.readStream.schema(SEEN).parquet(source)
    jobs.write_stream(stream, table, f"{folder}/checkpoint").awaitTermination()
    for name in ("0", ".0.crc"):  # a lost commit makes the same batch run again
        Path(f"{folder}/checkpoint/commits/{name}").unlink()
    jobs.write_stream(stream, table, f"{folder}/checkpoint").awaitTermination()
    assert spark.read.parquet(table).count() == 1


def test_a_new_checkpoint_does_not_overwrite_an_old_table(spark, folder):
    source, table = f"{folder}/in", f"{folder}/table"
    land(spark, source, [("a", 1, at(0))], SEEN)
    stream = spark.readStream.schema(SEEN).parquet(source)
    jobs.write_stream(stream, table, f"{folder}/one").awaitTermination()
    with pytest.raises(ValueError):
        jobs.write_stream(stream, table, f"{folder}/two")
    assert spark.read.parquet(table).count() == 1


def test_histogram_stream_equals_batch_of_windows(spark, folder):
    source, schema = f"{folder}/in", "latency_ms int, ts timestamp"
    land(spark, source, [(50, at(1)), (700, at(2)), (40000, at(25))], schema)
    run(jobs.stream_histogram(spark.readStream.schema(schema).parquet(source), "1 day", "1 day"), folder, "update")
    got = jobs.latest_rows(spark, f"{folder}/table", ["window_start", "le"], ["bucket_count"])
    counts = {(r.window_start, r.le): r.bucket_count for r in got.collect()}
    assert (counts[at(0), "100"], counts[at(0), "1000"], counts[at(0), "+Inf"]) == (1, 2, 2)
    assert (counts[at(24), "30000"], counts[at(24), "+Inf"]) == (0, 1)


def test_messages_need_one_origin(spark):
    with pytest.raises(ValueError):
        topics.read_static_results(spark)
    with pytest.raises(ValueError):
        topics.read_requests(spark, path="x", servers="y")

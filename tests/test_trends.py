"""Trends by signed differences, against a full recount."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from diffmill.operators import reviews, trends
from diffmill.session import work_dir

REVIEW = "job_id string, repo string, created_at timestamp, quality_score int"


@pytest.fixture
def path(spark):
    return work_dir(spark, "trend")


def random_review(rng, i):
    day = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 60))
    return (f"j{i}", rng.choice(["a", "b", None]), day, rng.choice([None, rng.randrange(101)]))


def rows(df):
    return sorted(map(str, df.select("repo", "period", "reviews", "score_sum", "mean_score", "good", "fair", "poor").collect()))


def test_batches_of_upserts_give_the_recount(spark, path):
    rng = random.Random(61)
    current = {f"j{i}": random_review(rng, i) for i in range(300)}
    frame = lambda found: spark.createDataFrame(list(found), REVIEW)
    trends.add_batch(path, 0, frame(current.values()))
    for batch in (1, 2, 3):
        changed = {f"j{i}": random_review(rng, i) for i in rng.sample(range(330), 60)}
        gone = set(rng.sample(sorted(changed), 5))
        old = [current[j] for j in changed if j in current]
        new = [r for j, r in changed.items() if j not in gone]
        for _ in range(2):  # a batch that runs again counts once
            trends.add_batch(path, batch, frame(new), frame(old))
        current = {j: r for j, r in (current | changed).items() if j not in gone}
        for grain in ("day", "month"):
            assert rows(trends.read_trend(spark, path, grain)) == rows(reviews.quality_trend(frame(current.values()), grain))
    trends.compact(spark, path, f"{path}-compact")
    assert rows(trends.read_trend(spark, f"{path}-compact")) == rows(trends.read_trend(spark, path))


def test_a_batch_touches_its_days_and_a_reader_its_own(spark, path):
    base = spark.createDataFrame([(f"j{d}", "a", dt.datetime(2024, 1, d + 1), 50) for d in range(20)], REVIEW)
    trends.add_batch(path, 0, base)
    trends.add_batch(path, 1, base.where("job_id = 'j3'").withColumn("quality_score", F.lit(90)), base.where("job_id = 'j3'"))
    assert spark.read.parquet(f"{path}/batch=1").select("day").distinct().count() == 1
    some = trends.read_trend(spark, path, "day", dt.date(2024, 1, 4), dt.date(2024, 1, 4))
    assert [(r.reviews, r.score_sum, r.good, r.fair) for r in some.collect()] == [(1, 90, 1, 0)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(day,2024-01-04)" in plan
    # a change that changes nothing leaves no row
    trends.add_batch(path, 2, base, base)
    assert trends.read_trend(spark, path).count() == 20

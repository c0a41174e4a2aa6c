"""Numbers of natural keys: dense, unique and stable over loads and replays."""

import random

import pytest

from diffmill.operators import surrogates
from diffmill.session import work_dir

KEYS = "repo string, job_id string"


@pytest.fixture
def path(spark):
    return work_dir(spark, "dictionary")


def numbers(spark, path):
    return {tuple(r)[:-1]: r.id for r in surrogates.read_dictionary(spark, path).select("repo", "job_id", "id").collect()}


def random_loads():
    rng = random.Random(41)
    pool = [(rng.choice(["a", "b", None, ""]), rng.choice([None, f"j{rng.randrange(400)}"])) for _ in range(900)]
    return [[rng.choice(pool) for _ in range(500)] for _ in range(3)]


def plain(loads):
    out = {}
    for rows in loads:
        fresh = sorted({r for r in rows} - set(out), key=lambda r: [(x is not None, x or "") for x in r])
        for r in fresh:
            out[r] = len(out) + 1
    return out


def test_three_loads_and_a_replay(spark, path):
    loads = random_loads()
    for n, rows in enumerate(loads):
        surrogates.extend_dictionary(spark, path, spark.createDataFrame(rows, KEYS).repartition(7), n)
        got = numbers(spark, path)
        assert got == plain(loads[: n + 1])
    assert sorted(got.values()) == list(range(1, len(got) + 1))
    for n in (1, 2):  # as after a failure
        surrogates.extend_dictionary(spark, path, spark.createDataFrame(loads[n], KEYS).repartition(3), n)
        assert numbers(spark, path) == got


def test_order_of_loads_and_empty_loads(spark, path):
    with pytest.raises(ValueError):
        surrogates.extend_dictionary(spark, path, spark.createDataFrame([("a", "j")], KEYS), 1)
    surrogates.extend_dictionary(spark, path, spark.createDataFrame([], KEYS), 0)
    surrogates.extend_dictionary(spark, path, spark.createDataFrame([("a", "j"), ("a", "j")], KEYS), 1)
    assert numbers(spark, path) == {("a", "j"): 1}


def test_rows_get_their_numbers(spark, path):
    surrogates.extend_dictionary(spark, path, spark.createDataFrame([("a", "j"), ("b", None)], KEYS), 0)
    rows = spark.createDataFrame([("a", "j", 5), ("b", None, 6), ("c", "j", 7)], KEYS + ", id int")
    got = surrogates.with_numbers(rows, surrogates.read_dictionary(spark, path), ["repo", "job_id"])
    assert {r.repo: r.id for r in got.collect()} == {"a": 1, "b": 2, "c": None}


def test_no_task_sorts_all_keys(spark, path):
    surrogates.extend_dictionary(spark, path, spark.range(50_000).selectExpr("'r' as repo", "md5(cast(id as string)) as job_id"), 0)
    dictionary = surrogates.read_dictionary(spark, path)
    row = dictionary.selectExpr("min(id) as low", "max(id) as high", "count(distinct id) as n").first()
    assert (row.low, row.high, row.n) == (1, 50_000, 50_000)
    assert dictionary.orderBy("job_id").selectExpr("id").limit(3).collect() == [(1,), (2,), (3,)]

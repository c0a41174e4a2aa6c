import random

import pytest
from pyspark.sql import functions as F

from diffmill.operators.diffs import split_diff
from diffmill.sources.sections import read_sections


def diff(rng, i):
    out = [] if i % 3 else ["notes before", "", "diff -git no header"]
    for j in range(rng.randrange(1, 40)):
        out.append(f"diff --git a/src/f{j}.py b/src/f{j}.py")
        out += [rng.choice(["", "+é𝄞 added", "-gone", " diff --git inside", "\r", "+" + "x" * rng.randrange(200), "diff --gi", "dif"]) for _ in range(rng.randrange(6))]
    return "\n".join(out) + rng.choice(["", "\n", "\n\n"])


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, value in old.items():
        spark.conf.set(n, value)


@pytest.mark.parametrize("size", [97, 100_000])
def test_sections_equal_split_diff(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    texts = {f"d{i}.diff": diff(rng, i) for i in range(12)} | {"none.diff": "no header\nat all", "one.diff": "diff --git a/x b/x"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty.diff").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"diff --git a/y b/y")
    small_splits(size)
    read = read_sections(spark, str(tmp_path), "*.diff")
    got = read.select(F.substring_index("file", "/", -1).alias("file"), "segment", "path", "text").collect()
    if size < 1_000:
        assert read.rdd.getNumPartitions() > 20
    want = split_diff(spark.createDataFrame(list(texts.items()), "file string, diff string"), ["file"]).collect()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_diff_is_read_by_many_tasks(spark, tmp_path, small_splits):
    """One file of 60,000 sections: no task reads it whole, and its numbers have no gap."""
    section = "diff --git a/f{0} b/f{0}\n+line {0}\n"
    (tmp_path / "big.diff").write_text("".join(section.format(i) for i in range(60_000)))
    small_splits(1 << 18)
    rows = read_sections(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    top = rows.groupBy("task").count().agg(F.max("count"), F.count("*")).first()
    assert top[0] < 20_000 and top[1] >= 4
    wrong = rows.where(F.col("path") != F.concat(F.lit("f"), (F.col("segment") - 1).cast("string")))
    assert rows.count() == 60_000 and wrong.count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert not any("value" in line for line in exchanges)


def test_changed_splits_are_refused(spark, tmp_path, small_splits):
    (tmp_path / "a.diff").write_text("diff --git a/f b/f\n+line\n" * 500)
    small_splits(1_000)
    read = read_sections(spark, str(tmp_path))
    small_splits(1_700)
    with pytest.raises(Exception, match="splits changed"):
        read.collect()

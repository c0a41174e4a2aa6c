"""Sources and sinks over a working folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from diffmill import session
from diffmill.schemas import FINDINGS, REVIEWS
from diffmill.sources import tables, topics, trees


@pytest.fixture
def folder(spark):
    return session.work_dir(spark, "test")


DAY = dt.datetime(2024, 1, 1)


def stored_reviews(spark, n=6):
    rows = [
        (i, f"j{i}", "o/r", i, "sha", "running", None, None, None, DAY + dt.timedelta(days=i % 3), None) for i in range(n)
    ]
    return spark.createDataFrame(rows, REVIEWS)


def test_upsert_rewrites_only_touched_days(spark, folder):
    tables.write_reviews(stored_reviews(spark), folder)
    before = {r.path: r.m for r in files(spark, folder)}
    changes = spark.createDataFrame(
        [("j1", "failed", 99, 1), ("j1", "done", 90, 2), ("j4", "failed", None, 1), ("jx", "done", 1, 1)],
        "job_id string, status string, quality_score int, at int",
    )
    tables.upsert_table(spark, folder, changes, "job_id", ["status", "quality_score"], ["at"])
    got = tables.read_table(spark, folder)
    assert sorted(map(tuple, got.select("id", "status", "quality_score").collect())) == [
        (0, "running", None), (1, "done", 90), (2, "running", None), (3, "running", None), (4, "failed", None),
        (5, "running", None),
    ]
    after = {r.path: r.m for r in files(spark, folder)}
    kept = {p for p in before if "2024-01-02" not in p}
    assert kept == {p for p in after if "2024-01-02" not in p}
    assert {p for p in before if "2024-01-02" in p}.isdisjoint(after)


def files(spark, folder):
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return listed.load(folder).select("path", F.col("modificationTime").alias("m")).collect()


def test_findings_round_trip(spark, folder):
    rows = [(i, i % 3, i, "suggestion", "low", None, None, "m", None, DAY) for i in range(10)]
    df = spark.createDataFrame(rows, FINDINGS)
    tables.write_findings(df, folder)
    tables.write_findings(df.limit(0), folder)
    got = tables.read_table(spark, folder)
    assert sorted(got.drop("created_on").collect()) == sorted(df.collect())


def test_source_tree(spark, tmp_path):
    kept = ("a.js", "src/b.TS", "src/caf\xe9.py", "src/__tests__/a.test.ts", "pages/_app.tsx", "src/__init__.py", "_/_b.js")
    for name in (*kept, "src/.hidden/c.js", "node_modules/d.js", "src/node_modules/x/g.js", ".e.js", "src/f.md"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"// {name}\nif (x)")
    (tmp_path / "latin.py").write_bytes(b"caf\xe9 = 1")
    got = dict(trees.read_source_tree(spark, str(tmp_path)).collect())
    assert got == {**{n: f"// {n}\nif (x)" for n in kept}, "latin.py": "caf\ufffd = 1"}


def test_several_checkouts(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "_a.js").write_text(name)
    checkouts = spark.createDataFrame([(n, 1, str(tmp_path / n)) for n in ("one", "two")], "repo string, sha int, root string")
    got = trees.decoded(trees.checkout_files(checkouts)).collect()
    assert sorted(map(tuple, got)) == [("one", 1, "_a.js", "one"), ("two", 1, "_a.js", "two")]
    assert trees.checkout_files(checkouts.limit(0)).collect() == []


def test_to_topic(spark):
    df = spark.createDataFrame([("j", 1, None)], "job_id string, n int, x string")
    assert tuple(topics.to_topic(df).first()) == ("j", '{"job_id":"j","n":1}')


def test_work_dir_stays_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = session.work_dir(spark, "x")
    assert path != session.work_dir(spark, "x")
    if shared:
        assert path.startswith(shared)


def test_no_local_folder_on_a_cluster():
    class Conf(dict):
        pass

    class Remote:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        session.work_dir(Remote(), "x")

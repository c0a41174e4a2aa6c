"""Stored reviews: the rows of the plain operators, without a shuffle of findings."""

import pytest
from pyspark.sql import functions as F

from diffmill.operators import reviews
from diffmill.plans import views as V
from diffmill.plans.queries import _store, all_queries, findings
from diffmill.session import work_dir
from diffmill.sources import buckets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    heads = V.reviews(spark, SF)
    hot = F.when(F.col("review_id") % 7 == 0, heads.agg(F.min("id")).first()[0]).otherwise(F.col("review_id"))
    return heads, findings(spark, SF).withColumn("review_id", hot)


@pytest.fixture(scope="module", params=[50_000, 60])
def store(spark, request, tables):
    made = buckets.store_reviews(*tables, work_dir(spark, "store"), 5, request.param)
    yield made
    buckets.drop_store(spark, made)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def moved(df, table):
    """Steps of the physical plan above the scan of a table that deal its rows out anew."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [min(x.find(c) for c in (*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "*") if c in x) if any(map(str.isupper, x)) else 0 for x in lines]
    scans = [i for i, x in enumerate(lines) if "FileScan" in x and table in x]
    assert scans
    above = []
    for i in scans:
        at = depth[i]
        for k in range(i, -1, -1):
            if depth[k] < at:
                at = depth[k]
                above.append(lines[k])
    return [x for x in above if "Exchange" in x]


def test_detail_equals_the_plain_one(spark, store, tables):
    got = buckets.stored_detail(spark, store, V.ORDINAL)
    want = reviews.review_detail(*tables, V.ORDINAL, store.page_findings)
    columns = ["id", "page", "status", "uml_s3_url", "findings"]
    assert rows(got, *columns) == rows(want, *columns)
    assert (store.large is not None) == (store.page_findings == 60)


def test_detail_attach_and_cascade_move_no_findings(spark, store, tables):
    if store.large is not None:
        pytest.skip("pages of large reviews are dealt out")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        detail = buckets.stored_detail(spark, store, V.ORDINAL)
        assert moved(detail, store.findings) == moved(detail, store.reviews) == []
        dealt = reviews.review_detail(spark.table(store.reviews), spark.table(store.findings), V.ORDINAL)
        assert moved(dealt, store.findings)
        keyed = tables[1].withColumn("job_id", F.expr("md5(cast(review_id as varchar(20)))")).drop("review_id")
        incoming = buckets.store_incoming(keyed, work_dir(spark, "incoming"), 5)
        attached = buckets.stored_attach(spark, incoming, store)
        assert moved(attached, incoming) == moved(attached, store.keys) == []
        want = reviews.attach_review_id(keyed, tables[0])
        assert rows(attached, "review_id", "message", "l_extendedprice") == rows(want, "review_id", "message", "l_extendedprice")
        doomed = tables[0].where("id % 3 = 0").select("job_id")
        left, rest = buckets.stored_cascade(spark, store, doomed)
        assert moved(rest, store.findings) == moved(left, store.reviews) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cascade_equals_the_plain_one(spark, store, tables):
    doomed = tables[0].where("id % 3 = 0").select("job_id")
    got, want = buckets.stored_cascade(spark, store, doomed), reviews.delete_jobs(*tables, doomed)
    assert rows(got[0], "id") == rows(want[0], "id")
    assert rows(got[1], "review_id", "message", "l_extendedprice") == rows(want[1], "review_id", "message", "l_extendedprice")


def test_buckets_follow_the_number_of_rows(spark, monkeypatch):
    assert [buckets.buckets_for(spark.range(n), 4, 100) for n in (0, 400, 401, 3200)] == [4, 4, 8, 32]
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 100)
    made = _store(spark, SF)
    most = spark.table(made.findings).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    counts = {
        spark.sql(f"DESCRIBE TABLE EXTENDED {t}").where("col_name = 'Num Buckets'").first()[1]
        for t in (made.reviews, made.findings, made.keys)
    }
    buckets.drop_store(spark, made)
    assert counts == {str(buckets.buckets_for(V.table(spark, SF, "lineitem"), 16))} == {"64"} and most < 200


def test_attach_stores_no_more_than_the_keys_of_reviews(spark):
    before = {t.name for t in spark.catalog.listTables()}
    got = all_queries()["stored_attach"](spark, SF)
    made = {t.name for t in spark.catalog.listTables()} - before
    assert rows(got, *got.columns) == rows(all_queries()["attach_review_id"](spark, SF), *got.columns)
    for t in made:
        spark.sql(f"DROP TABLE {t}")
    assert sorted(t.rsplit("_", 1)[0] for t in made) == ["incoming", "review_keys"]


def test_detail_of_more_buckets_has_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 100)
    run, columns = all_queries()["stored_review_detail"], ["id", "page", "n_findings", "findings"]
    before = {t.name for t in spark.catalog.listTables()}
    got = run(spark, SF)
    made = [t.name for t in spark.catalog.listTables() if t.name not in before and t.name.startswith("findings_")]
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {made[0]}").where("col_name = 'Num Buckets'").first()[1]
    assert told == "64"  # 16 before, however many rows there are
    many = rows(got, *columns)
    monkeypatch.undo()
    assert many == rows(run(spark, SF), *columns)
    for t in {t.name for t in spark.catalog.listTables()} - before:
        spark.sql(f"DROP TABLE {t}")


def test_queries_store_what_they_read(spark):
    """Each column and table that nothing reads is shuffled and written all the same."""
    for name, plain, tables_made, of_findings in (
        ("stored_review_detail", "review_detail", ["findings", "reviews"], {"review_id", "id", "type", "severity", "message", "created_at", *V.ORDINAL}),
        ("stored_cascade", "delete_cascade_findings", ["findings", "review_keys", "reviews"], {"review_id", "message", "l_extendedprice"}),
    ):
        before = {t.name for t in spark.catalog.listTables()}
        got = all_queries()[name](spark, SF)
        made = {t.name for t in spark.catalog.listTables() if t.name.startswith(("reviews_", "findings_", "review_keys_"))} - before
        assert sorted(t.rsplit("_", 1)[0] for t in made) == tables_made
        assert set(spark.table(next(t for t in made if t.startswith("findings_"))).columns) == of_findings
        shown = [c for c in all_queries()[plain](spark, SF).columns if c in got.columns and c != "findings"]
        assert shown and rows(got, *shown) == rows(all_queries()[plain](spark, SF), *shown)
        for t in made:
            spark.sql(f"DROP TABLE {t}")

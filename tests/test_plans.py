"""What the physical plans must and must not hold."""

import contextlib
import io
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from diffmill.operators import responses
from diffmill.operators.deliveries import accepted_deliveries
from diffmill.plans import views as V
from diffmill.plans.queries import all_queries as queries
from diffmill.session import work_dir
from diffmill.sources.deliveries import read_deliveries

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in queries() if not n.startswith("stream_"))
# One row comes out of these, or the n newest of a sorted list.
GLOBAL = {"latency_histogram_total", "assign_ids", "run_events"}
# A scorer is plugged in, or names are looked for by an automaton.
PYTHON = {"score_diffs_custom", "scored_reviews", "rebuild_diff_contains"}


def text_of(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def plan_of(spark, name, mode="formatted"):
    return text_of(queries()[name](spark, SF), mode)


@pytest.mark.parametrize("name", BATCH)
def test_plan(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InPandas" not in plan
    if name not in GLOBAL:
        assert "SinglePartition" not in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = plan_of(spark, "top3_findings", "simple")
    partial, final = plan.index(", Partial"), plan.index(", Final")
    assert final < plan.index("Exchange") < partial  # plans print from the top down
    assert "TakeOrderedAndProject" in plan_of(spark, "latest_reviews")


def test_one_shuffle_of_findings(spark):
    """Ranking, gathering and the join with reviews share one partitioning."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("render_comment", "review_detail"):
            assert plan_of(spark, name, "simple").count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("name", ["classify_delivery", "review_requests", "split_diff", "review_responses", "explode_findings"])
def test_no_shuffle_at_all(spark, name):
    plan = plan_of(spark, name, "simple")
    assert plan.count("Exchange") == (1 if name == "split_diff" else 0)  # the view gathers its diffs


def test_bodies_are_parsed_once(spark):
    plan = plan_of(spark, "review_requests")
    assert plan.count("parseJson") == 1


def test_filters_and_columns_reach_the_scan(spark):
    assert "EqualTo(o_orderkey,42)" in plan_of(spark, "review_by_id")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan_of(spark, "status_counts")
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan_of(spark, "findings_count")
    sent = V.deliveries(V.table(spark, SF, "events"))
    path = work_dir(spark, "test")
    sent.write.parquet(path)
    landed = read_deliveries(spark, path, "parquet")
    plan = text_of(accepted_deliveries(landed, V.SECRET))
    assert re.search(r"PushedFilters: \[.*EqualTo\(event,pull_request\).*StringStartsWith\(signature,sha256=\)", plan)


def test_repeated_requests_are_folded_without_their_diffs(spark):
    rows = [(f"j{i % 5}", "o/r", i % 5, "sha", f"diff {i % 5}") for i in range(20)]
    path = work_dir(spark, "test")
    spark.createDataFrame(rows, "job_id string, repo string, pr_number int, commit_sha string, diff string").write.parquet(path)
    requests = spark.read.parquet(path)
    raw = spark.createDataFrame([("j1", '{"quality_score": 55, "findings": []}')], "job_id string, raw string")
    joined = responses.join_responses(requests, responses.review_responses(raw))
    assert sorted((r.job_id, r.diff) for r in joined.collect()) == [(f"j{i}", f"diff {i}") for i in range(5)]
    run = responses.run_reviews(joined, F.lit("2024-01-01").cast("timestamp"))
    for part in (run.reviews, run.findings, run.events):
        assert not re.search(r"\bdiff[#:]", text_of(part))
    assert {r.job_id for r in run.reviews.collect()} == {f"j{i}" for i in range(5)}


def test_nothing_is_collected_in_the_library():
    package = Path(__file__).resolve().parents[1] / "diffmill"
    for path in (p for p in package.rglob("*.py") if "llm" not in p.relative_to(package).parts):
        source = path.read_text()
        assert not re.search(r"\.(collect|toPandas|localCheckpoint|crossJoin|toLocalIterator)\(", source), path

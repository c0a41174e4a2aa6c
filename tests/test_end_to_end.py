"""One delivery from the signed body to the finished, measured and deleted review."""

import json

from pyspark.sql import functions as F

from diffmill.functions.signature import hmac_sha256
from diffmill.operators import comments, deliveries, responses, reviews, scoring
from diffmill.schemas import REQUEST, STATIC_RESULT
from diffmill.session import work_dir
from diffmill.sources import tables, topics

DIFF = """diff --git a/lib/stock.py b/lib/stock.py
--- a/lib/stock.py
+++ b/lib/stock.py
@@ -10,4 +10,3 @@
 def left(shelf):
-    total = len(shelf)
-    return total
+    return sum(shelf.values())
diff --git a/web/cart.tsx b/web/cart.tsx
new file mode 100644
--- /dev/null
+++ b/web/cart.tsx
@@ -0,0 +1 @@
+export const empty = [];
"""
PAYLOAD = {
    "repository": {"full_name": "harbor/warehouse"},
    "pull_request": {"number": 48, "head": {"sha": "9f8e7d6c5b4a"}, "title": "Count what is left"},
    "action": "synchronize",
    "diff": DIFF,
}
METRICS = {
    "file_metrics": [
        {"file_path": "lib/stock.py", "language": "python", "issues": 0, "cyclomatic_complexity": 0, "line_count": 31,
         "errors": 0, "warnings": 0},
        {"file_path": "web/cart.tsx", "language": "typescript", "issues": 2, "cyclomatic_complexity": 4, "line_count": 12,
         "errors": 1, "warnings": 1},
    ],
    "counts": {"issues": 2, "errors": 1, "warnings": 1, "files_analyzed": 2},
}


def test_end_to_end(spark):
    folder, secret = work_dir(spark, "test"), "test-secret"
    sent = spark.createDataFrame([("pull_request", json.dumps(PAYLOAD))], "event string, raw_body string")
    sent = sent.withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(F.col("raw_body"), secret)))
    classified = deliveries.classify_delivery(sent, secret).first()
    assert (classified.http_status, classified.inline_diff) == (202, DIFF)

    messages = topics.to_topic(deliveries.review_requests(deliveries.accepted_deliveries(sent, secret)))
    requests, bad = deliveries.parse_messages(messages, REQUEST)
    assert bad.count() == 0
    scored = scoring.score_diffs(requests, ["job_id"])
    joined = responses.join_responses(requests, responses.review_responses(scored))
    run = responses.run_reviews(joined, F.lit("2024-01-01").cast("timestamp"))
    tables.write_reviews(run.reviews, f"{folder}/reviews")
    tables.write_findings(run.findings, f"{folder}/findings")
    stored = tables.read_table(spark, f"{folder}/reviews")
    found = tables.read_table(spark, f"{folder}/findings")
    job = stored.first().job_id
    assert (stored.first().status, stored.first().quality_score, found.count()) == ("done", 80, 1)
    body = comments.comment_outbox(stored, run.shown).first().body
    assert "1. **SUGGESTION** - Consider adding more detailed comments" in body

    value = json.dumps({"job_id": job, "static_metrics": METRICS})
    results, _ = deliveries.parse_messages(
        spark.createDataFrame([(value, 1), ("{bad", 2)], "value string, offset_no long"), STATIC_RESULT
    )
    texts = results.withColumn("static_metrics", F.to_json("static_metrics"))
    changes = reviews.latest_static(texts)
    tables.upsert_table(spark, f"{folder}/reviews", changes, "job_id", ["static_metrics"])
    stored = tables.read_table(spark, f"{folder}/reviews")
    assert json.loads(reviews.by_job(stored, job).first().static_metrics) == METRICS
    stage = reviews.reconcile(requests, stored, found).first()
    assert (stage.stage, stage.has_static, stage.findings) == ("done", True, 1)

    left, kept = reviews.delete_jobs(stored, found, requests)
    assert (left.count(), kept.count()) == (0, 0)

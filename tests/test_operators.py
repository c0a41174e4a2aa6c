"""Table operators on hand-made tables: edge cases and invariants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from diffmill import fixed
from diffmill.functions.signature import hmac_sha256
from diffmill.operators import artifacts, comments, deliveries, diffs, metrics, responses, reviews, scoring, telemetry
from diffmill.plans import views as V
from diffmill.plans.paging import number_pages, split_by_size
from diffmill.schemas import REQUEST

SF = "/root/testdata/sf0.001"
SECRET = "s"
FINDING = "review_id long, ordinal int, type string, severity string, file_path string, line_number int, message string, suggestion string, created_at timestamp_ntz"


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


# Deliveries

def delivered(spark, *bodies, event="pull_request"):
    df = spark.createDataFrame([(i, event, b) for i, b in enumerate(bodies)], "i int, event string, raw_body string")
    sent = F.coalesce(F.nullif(F.col("raw_body"), F.lit("")), F.lit("{}"))
    return df.withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(sent, SECRET)))


BODY = '{"repository": {"full_name": "test/repo"}, "pull_request": {"number": 123, "head": {"sha": "abc123def456"}}%s}'


def test_classify_precedence(spark):
    sent = delivered(spark, BODY % "", "{bad", "", '{"repository": "x"}', BODY.replace("123,", "0,") % "", "[]", "5")
    outcome = [r.outcome for r in deliveries.classify_delivery(sent, SECRET).orderBy("i").collect()]
    assert outcome == [
        "accepted", "unreadable_body", "missing_fields", "missing_fields", "missing_fields", "missing_fields",
        "unreadable_body",
    ]
    other = deliveries.classify_delivery(delivered(spark, BODY % "", event="push"), SECRET).first()
    assert (other.outcome, other.http_status) == ("ignored", 200)
    no_event = deliveries.classify_delivery(delivered(spark, BODY % "", event=None), SECRET).first()
    assert no_event.outcome == "ignored"
    unsigned = deliveries.classify_delivery(sent.withColumn("signature", F.lit("")), SECRET).orderBy("i").first()
    assert (unsigned.outcome, unsigned.http_status) == ("no_signature", 401)


def test_inline_diff_is_a_non_empty_string(spark):
    sent = delivered(spark, *[BODY % f', "diff": {d}' for d in ('"+x"', '""', "5", "null", '{"a": 1}', "true")])
    got = [r.inline_diff for r in deliveries.extract_pr(sent).orderBy("i").collect()]
    assert got == ["+x", None, None, None, None, None]


def test_payload_of_the_end_to_end_case(spark):
    diff = "diff --git a/src/test.js b/src/test.js\n@@ -1,5 +1,7 @@\n function test() {\n+  const x = 1;\n+  const y = 2;\n"
    sent = delivered(spark, BODY % (', "diff": ' + json.dumps(diff)))
    request = deliveries.review_requests(deliveries.accepted_deliveries(sent, SECRET)).first()
    assert (request.repo, request.pr_number, request.commit_sha, request.diff) == ("test/repo", 123, "abc123def456", diff)
    again = deliveries.review_requests(deliveries.accepted_deliveries(sent, SECRET)).first()
    assert request.job_id == again.job_id


def test_resolve_diff(column):
    got = column(
        [("a", "b", "c"), ("", "b", "c"), (None, None, "c"), ("", "", None)],
        deliveries.resolve_diff(F.col("x"), F.col("y"), F.col("z")),
        "x string, y string, z string",
    )
    assert got == ["a", "b", "c", None]


def test_missing_fields(spark):
    df = spark.createDataFrame([("a", 1), ("", 1), (None, 1), ("a", 0), ("a", None)], "s string, n int")
    got = [r[0] for r in df.select(deliveries.missing_fields(df, ["s", "n"])).collect()]
    assert got == [False, True, True, True, True]


def test_parse_messages_keeps_every_message(spark):
    values = ['{"job_id": "j", "pr_number": 7}', "", None, " ", "{bad", "[1]", "5", "null", '{"job_id": "k"} x', "{}"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    good, rest = deliveries.parse_messages(df, REQUEST)
    assert rows(good, "i", "job_id", "pr_number") == [(0, "j", 7), (9, None, None)]
    reasons = dict(rest.select("i", "reason").collect())
    assert reasons == {1: "blank", 2: "blank", **{i: "malformed" for i in range(3, 9)}}


# Diffs

def test_split_diff_joins_back(spark):
    texts = [
        "diff --git a/x b/x\n+1\n\ndiff --git a/y b/y\n-2",
        "preamble\nmore\ndiff --git a/x b/x",
        "no header\n",
        "",
        "\ndiff --git a/x b/x\n x diff --git a/q b/q\n",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, diff string")
    parts = diffs.split_diff(df, ["i"]).collect()
    for i, t in enumerate(texts):
        mine = sorted((p for p in parts if p.i == i), key=lambda p: p.segment)
        assert "\n".join(p.text for p in mine) == t
    assert [(p.segment, p.path) for p in parts if p.i == 0] == [(1, "x"), (2, "y")]
    assert [(p.segment, p.path) for p in parts if p.i == 1] == [(0, None), (1, "x")]
    assert [(p.segment, p.path) for p in parts if p.i == 3] == [(0, None)]


FILES = "repo string, pr_number int, seq int, filename string, status string, is_binary boolean, patch string, head_sha string"


def pull_request(spark):
    diff = "diff --git a/data.js b/data.js\n-d\ndiff --git a/a.js b/a.js\n-a\ndiff --git a/b.js b/b.js\n-b"
    prs = spark.createDataFrame([("r", 1, diff), ("r", 2, "as it was")], "repo string, pr_number int, diff string")
    files = spark.createDataFrame([
        ("r", 1, 0, "gone.js", "removed", False, "x", "sha1234567"),
        ("r", 1, 1, "pic.png", "added", True, None, "sha1234567"),
        ("r", 1, 2, "new.js", "added", False, "@@\n+n", "sha1234567"),
        ("r", 1, 3, "moved.js", "renamed", None, "", "sha1234567"),
        ("r", 1, 4, "a.js", "modified", False, None, "sha1234567"),
        ("r", 1, 5, "lost.js", "added", False, None, "sha1234567"),
        ("r", 1, 6, "b.js", "modified", False, "@@\n+b", "sha1234567"),
        ("r", 1, 7, "none.js", "modified", False, None, "sha1234567"),
        ("r", 2, 0, "gone.js", "removed", False, "x", "sha1234567"),
    ], FILES)
    contents = spark.createDataFrame([("r", "sha1234567", "moved.js", "l1\nl2\n")], "repo string, sha string, path string, content string")
    return prs, files, contents


HEAD = "diff --git a/new.js b/new.js\nnew file mode 100644\n@@\n+n\ndiff --git a/moved.js b/moved.js\nnew file mode 100644\nindex 0000000..sha1234\n--- /dev/null\n+++ b/moved.js\n+l1\n+l2\n+\n"
TAIL = "\ndiff --git a/b.js b/b.js\n@@\n+b"


def test_rebuild_diff(spark):
    got = {r.pr_number: (r.diff, r.rebuilt) for r in diffs.rebuild_diff(*pull_request(spark)).collect()}
    assert got == {1: (HEAD + "diff --git a/a.js b/a.js\n-a" + TAIL, True), 2: ("as it was", False)}


def test_rebuild_diff_contains_takes_longer_names(spark):
    got = {r.pr_number: r.diff for r in diffs.rebuild_diff(*pull_request(spark), match="contains").collect()}
    run = "diff --git a/data.js b/data.js\n-d\ndiff --git a/a.js b/a.js\n-a"
    assert got == {1: HEAD + run + TAIL, 2: "as it was"}


def test_contains_against_brute_force(spark):
    """Names that hold one another, headers in mid-line, repeated and missing files."""
    rng = random.Random(7)
    pool = ["a.js", "data.js", "src/a.js", "b.js", "lib/b.js"]
    lines = ["+x", "-y", "", " @@", "+ diff --git a/a.js b/a.js", "text a.js"]
    prs, files = [], []
    for pr in range(60):
        text = [rng.choice(lines) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 6)):
            name = rng.choice(pool)
            text += [f"diff --git a/{name} b/{name}", *(rng.choice(lines) for _ in range(rng.randint(0, 3)))]
        prs.append(("r", pr, "\n".join(text)))
        files += [("r", pr, i, n, "modified", False, None, "s") for i, n in enumerate(rng.sample(pool, 3))]

    def section(diff, name):
        split = diff.split("\n")
        opens = [("diff --git" in x and name in x) for x in split]
        ends = [x.startswith("diff --git") and not o for x, o in zip(split, opens)]
        if True not in opens:
            return None
        start = opens.index(True)
        stop = next((i for i in range(start, len(split)) if ends[i]), len(split))
        return "\n".join(split[start:stop])

    want = {}
    for _, pr, diff in prs:
        parts = [section(diff, f[3]) for f in files if f[1] == pr]
        found = [p for p in parts if p is not None]
        want[pr] = "\n".join(found) if found else diff
    none = spark.createDataFrame([], "repo string, sha string, path string, content string")
    got = diffs.rebuild_diff(
        spark.createDataFrame(prs, "repo string, pr_number int, diff string"), spark.createDataFrame(files, FILES), none, "contains"
    )
    assert {r.pr_number: r.diff for r in got.collect()} == want


def test_rebuild_diff_in_pages(spark):
    prs, files, contents = V.prs(spark, SF), V.pr_files(spark, SF), V.pr_contents(spark, SF)
    whole = {(r.repo, r.pr_number): (r.diff, r.rebuilt) for r in diffs.rebuild_diff(prs, files, contents).collect()}
    paged = {}
    for r in diffs.rebuild_diff(prs, files, contents, page_files=2).orderBy("repo", "pr_number", "page").collect():
        paged.setdefault((r.repo, r.pr_number), []).append(r)
    assert any(len(p) > 1 for p in paged.values())
    assert {k: ("\n".join(r.diff for r in p), p[0].rebuilt) for k, p in paged.items()} == whole


# Metrics

def test_golden_metrics_document(spark):
    one = spark.createDataFrame(
        [("j", "src/test.js", "javascript", 3, 7, 150, 0, 3)],
        "job_id string, file_path string, language string, issues long, cyclomatic_complexity int, line_count int, errors long, warnings long",
    )
    message = metrics.metrics_message(metrics.metrics_document(one, ["job_id"]), "job_id").first()
    assert json.loads(message.static_metrics) == {
        "file_metrics": [{
            "file_path": "src/test.js", "language": "javascript", "issues": 3, "cyclomatic_complexity": 7,
            "line_count": 150, "errors": 0, "warnings": 3,
        }],
        "counts": {"issues": 3, "errors": 0, "warnings": 3, "files_analyzed": 1},
    }


def test_metrics_document_in_pages(spark):
    files = metrics.file_metrics(V.code(spark, SF), V.lint(spark, SF), keys=("doc_id",), carry=("repo", "file_path"))
    whole = {r.repo: r for r in metrics.metrics_document(files, ["repo"]).collect()}
    paged = {}
    for r in metrics.metrics_document(files, ["repo"], page_files=3).orderBy("repo", "page").collect():
        paged.setdefault(r.repo, []).append(r)
    assert paged.keys() == whole.keys()
    for repo, pages in paged.items():
        assert [r.page for r in pages] == list(range(len(pages)))
        assert all(len(r.file_metrics) <= 3 for r in pages)
        assert [f for r in pages for f in r.file_metrics] == whole[repo].file_metrics
        assert all(r.counts == whole[repo].counts for r in pages)
    assert max(map(len, paged.values())) > 1


def test_file_metrics_edges(spark):
    files = spark.createDataFrame([
        ("r", "a.ts", "if (a) {}"), ("r", "a.py", "if (a): ?"), ("r", "b.js", None), ("r", "c.js", ""),
    ], "repo string, file_path string, content string")
    lint = spark.createDataFrame([("r", "a.ts", 2), ("r", "a.ts", 1), ("r", "a.py", 2)], "repo string, file_path string, severity int")
    got = metrics.file_metrics(files, lint)
    assert rows(got, "file_path", "cyclomatic_complexity", "line_count", "issues", "errors", "warnings") == [
        ("a.py", 0, 1, 0, 0, 0), ("a.ts", 2, 1, 2, 1, 1), ("c.js", 1, 1, 0, 0, 0),
    ]


def test_counts_of_nothing_are_zero(spark):
    none = metrics.file_metrics(spark.createDataFrame([], "repo string, file_path string, content string"))
    assert tuple(metrics.metrics_counts(none).first()) == (0, 0, 0, 0)
    groups = spark.createDataFrame([("r",)], "repo string")
    assert rows(metrics.metrics_counts(none, ["repo"], groups)) == [("r", 0, 0, 0, 0)]


def test_changed_files(spark):
    schema = "repo string, file_path string, content string"
    base = spark.createDataFrame([("r", "same", "x"), ("r", "edit", "x"), ("r", "gone", "x")], schema)
    head = spark.createDataFrame([("r", "same", "x"), ("r", "edit", "y"), ("r", "new", "x")], schema)
    changes = metrics.changed_files(base, head)
    assert rows(changes, "file_path", "change") == [("edit", "modified"), ("gone", "deleted"), ("new", "added")]
    assert rows(metrics.analyzed_files(changes), "file_path") == [("edit",), ("new",)]


# Paging

@pytest.mark.parametrize("page_rows", [1, 7, 50])
def test_pages_are_whole_and_ordered(spark, page_rows):
    """One key holds most rows; its pages concatenate to the sorted group."""
    values = [("hot" if i % 3 else None if i % 2 else "cold%d" % (i % 4), i * 7919 % 1000, i) for i in range(600)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame(values, "k string, a int, b int").repartition(5)
    order = [F.col("a").desc(), F.col("b")]
    groups = split_by_size(df, ["k"], page_rows)
    paged = number_pages(groups.large, ["k"], order, page_rows).collect()
    small = groups.small.collect()
    assert sorted([tuple(r)[:3] for r in paged] + [tuple(r) for r in small], key=repr) == sorted(values, key=repr)
    for key in {r.k for r in paged}:
        mine = sorted((r for r in paged if r.k == key), key=lambda r: (-r.a, r.b))
        assert [r.page for r in mine] == [i // page_rows for i in range(len(mine))]


def test_no_large_groups(spark):
    groups = split_by_size(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], 5)
    assert groups.large is None and groups.small.count() == 10


# Reviews

def findings(spark, *items):
    made = []
    for i, (review, severity, extra) in enumerate(items):
        row = {"type": "code_smell", "file_path": None, "line_number": None, "message": f"m{i}", "suggestion": None, **extra}
        made.append((review, i, row["type"], severity, row["file_path"], row["line_number"], row["message"], row["suggestion"], None))
    return spark.createDataFrame(made, FINDING)


def test_top_findings_ties_keep_order(spark):
    df = findings(spark, *[(1, s, {}) for s in ("low", "odd", "critical", "low", "high", "critical")])
    got = [(r.position, r.message) for r in reviews.top_findings(df, 3).orderBy("position").collect()]
    assert got == [(1, "m2"), (2, "m5"), (3, "m4")]
    assert reviews.top_findings(df, 10).count() == 6


def reviews_of(spark, *items):
    return spark.createDataFrame(
        [(i, f"j{i}", "o/r", i, "sha", s, score, sm, sent, None) for i, s, score, sm, sent in items],
        "id long, job_id string, repo string, pr_number long, commit_sha string, status string, quality_score int, static_metrics string, github_comment_id string, created_at timestamp_ntz",
    )


def test_review_detail_without_findings(spark):
    detail = reviews.review_detail(
        reviews_of(spark, (1, "done", 90, '{"uml_s3_url": "u"}', None), (2, "done", 90, "{bad", None)),
        findings(spark, (1, "medium", {}), (1, "critical", {}), (9, "low", {})),
    )
    got = {r.id: ([f.message for f in r.findings], r.uml_s3_url, r.page) for r in detail.collect()}
    assert got == {1: (["m1", "m0"], "u", 0), 2: ([], None, 0)}


def test_review_detail_in_pages(spark):
    raw = V.raw_findings(spark, SF)
    whole = {r.id: r for r in reviews.review_detail(V.reviews(spark, SF), raw, V.ORDINAL).collect()}
    paged = {}
    for r in reviews.review_detail(V.reviews(spark, SF), raw, V.ORDINAL, page_findings=4).orderBy("id", "page").collect():
        paged.setdefault(r.id, []).append(r)
    assert paged.keys() == whole.keys()
    assert max(map(len, paged.values())) > 1
    for key, pages in paged.items():
        assert all(len(r.findings) <= 4 for r in pages)
        assert [f for r in pages for f in r.findings] == whole[key].findings
        assert {r.job_id for r in pages} == {whole[key].job_id}


def test_render_comment(spark):
    signature = "*made by a test*"
    rendered = comments.render_comment(
        reviews_of(spark, (1, "done", 90, None, None), (2, "done", 70, None, None)),
        findings(
            spark,
            (1, "low", {"type": "best_practice", "file_path": "a.js", "line_number": 0}),
            (1, "critical", {"type": "security_issue", "file_path": "b.js", "line_number": 4, "suggestion": "fix"}),
        ),
        signature=signature,
    )
    got = {r.id: r.body for r in rendered.collect()}
    bulb, robot, check = "\U0001f4a1", "\U0001f916", "✅"
    assert got[1] == (
        f"## {robot} AI Code Review\n\n**Quality Score:** 90/100\n\n### Top Suggestions:\n\n"
        f"1. **SECURITY ISSUE** (b.js:4) - m1\n   {bulb} *Suggestion:* fix\n\n"
        f"2. **BEST PRACTICE** (a.js) - m0\n\n---\n{signature}"
    )
    assert got[2] == (
        f"## {robot} AI Code Review\n\n**Quality Score:** 70/100\n\n{check} No major issues found!\n\n---\n{signature}"
    )


def test_comment_outbox_skips_sent(spark):
    mine = reviews_of(spark, (1, "done", 1, None, None), (2, "done", 1, None, "c"), (3, "failed", None, None, None), (4, "done", 1, None, None))
    none = findings(spark, (9, "low", {}))
    sent = spark.createDataFrame([(4,)], "id long")
    assert rows(comments.comment_outbox(mine, none), "id") == [(1,), (4,)]
    assert rows(comments.comment_outbox(mine, none, sent), "id") == [(1,)]


@pytest.mark.parametrize("wanted,found", [("2", [2]), (" 2abc", [2]), ("+2", [2]), ("2.9", [2]), ("-2", []), (2, [2])])
def test_by_id(spark, wanted, found):
    mine = reviews_of(spark, (1, "done", 1, None, None), (2, "done", 1, None, None))
    assert [r.id for r in reviews.by_id(mine, wanted).collect()] == found


def test_by_id_rejects_text(spark):
    for bad in ("abc", "", "x2"):
        with pytest.raises(ValueError):
            reviews.by_id(reviews_of(spark, (1, "done", 1, None, None)), bad)


def test_apply_static_last_wins(spark):
    mine = reviews_of(spark, (1, "done", 1, None, None), (2, "done", 1, "old", None))
    results = spark.createDataFrame([("j1", "a", 1), ("j1", "b", 3), ("j1", "c", 2), ("jx", "d", 4)], "job_id string, static_metrics string, offset_no long")
    updated, unmatched = reviews.apply_static(mine, results)
    assert rows(updated, "id", "static_metrics") == [(1, "b"), (2, "old")]
    assert rows(unmatched, "job_id") == [("jx",)]
    assert updated.columns == mine.columns


def test_delete_jobs_cascades(spark):
    mine = reviews_of(spark, (1, "done", 1, None, None), (2, "done", 1, None, None))
    jobs = spark.createDataFrame([("j1",), ("j1",), ("jz",)], "job_id string")
    left, kept = reviews.delete_jobs(mine, findings(spark, (1, "low", {}), (2, "low", {}), (2, "low", {})), jobs)
    assert rows(left, "id") == [(2,)]
    assert rows(kept, "review_id") == [(2,), (2,)]


def test_reconcile_stages(spark):
    mine = reviews_of(
        spark, (1, "done", 1, None, None), (2, "running", None, None, None), (3, "running", None, "{}", None),
        (4, "running", None, None, None), (5, "failed", None, None, None),
    )
    asked = spark.createDataFrame([(f"j{i}",) for i in range(1, 7)], "job_id string")
    got = dict(reviews.reconcile(asked, mine, findings(spark, (4, "low", {}))).select("job_id", "stage").collect())
    assert got == {"j1": "done", "j2": "review", "j3": "static_metrics", "j4": "findings", "j5": "failed", "j6": "published"}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    changes = spark.createDataFrame([(1, "z", None), (3, "q", 9)], "k int, s string, n int")
    assert rows(reviews.upsert(base, changes, "k", ["s", "n"])) == [(1, "z", None), (2, "b", 2)]
    again = spark.createDataFrame([(1, "new", 5, 2), (1, "old", 9, 1)], "k int, s string, n int, at int")
    assert rows(reviews.upsert(base, again, "k", ["s", "n"], ["at"])) == [(1, "new", 5), (2, "b", 2)]


def test_repeated_requests_and_responses(spark):
    raw = spark.createDataFrame([("a", '{"quality_score": 1}', 2), ("a", '{"quality_score": 9}', 1), ("a", None, 3)], "job_id string, raw string, at int")
    answered = responses.review_responses(raw)
    asked = requests(spark, "a", "b")
    joined = responses.join_responses(asked.union(asked), answered, ["at"])
    assert rows(joined, "job_id", "quality_score", "source") == [("a", 1, "model"), ("b", 85, "fallback")]
    run = responses.run_reviews(joined, F.lit("2024-01-01").cast("timestamp"))
    assert run.reviews.count() == 2 and set(run.findings.select("job_id").distinct().collect()) == {("b",)}
    assert reviews.reconcile(asked.union(asked), run.reviews, run.findings).count() == 2


def test_a_call_that_hangs_is_given_up(spark):
    def scorer(prompt):
        if "slow" in prompt.split("\n\n")[1]:
            import time

            time.sleep(3)
        return '{"quality_score": 42}'

    df = spark.createDataFrame([("a", "slow"), ("b", "good")], "job_id string, diff string").coalesce(1)
    scored = scoring.score_diffs(df, ["job_id"], scorer, limit_s=1.0)
    assert rows(scored, "job_id", "outcome") == [("a", "error"), ("b", "success")]


def test_first_per_job(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, None)], "job_id string, seq int, v string")
    assert rows(reviews.first_per_job(df, ["seq"])) == [("a", 1, "x", 2), ("b", 5, None, 1)]


def test_ids_are_stable_and_collisions_found(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "job_id string")
    first, again = reviews.assign_ids(df, ["job_id"]), reviews.assign_ids(df.repartition(3), ["job_id"])
    assert sorted(first.collect()) == sorted(again.collect())
    assert reviews.id_collisions(first, ["job_id"]).count() == 0
    same = df.withColumn("id", F.lit(1))
    assert rows(reviews.id_collisions(same, ["job_id"])) == [(1, 2)]


def test_new_reviews_checks_status(spark):
    asked = spark.createDataFrame([("j", "r", 1, "s")], "job_id string, repo string, pr_number int, commit_sha string")
    at = F.lit("2024-01-01").cast("timestamp")
    assert reviews.new_reviews(asked, "pending", at).first().status == "pending"
    with pytest.raises(ValueError):
        reviews.new_reviews(asked, "other", at)


def test_sha_matches(column):
    got = column([("abc\n", "abc"), (" abc", "abc"), ("abd", "abc")], reviews.sha_matches(F.col("h"), F.col("s")), "h string, s string")
    assert got == [True, True, False]


# Responses

ODD = [
    # raw, (fenced score, findings, source), (plain score, findings, source)
    ('{"quality_score": 7, "findings": [{"message": "a"}]}', (7, 1, "model"), (7, 1, "model")),
    ('{"findings": [{}]}', (80, 1, "model"), (80, 1, "model")),
    ('{"quality_score": 7, "findings": [{"message": "a"}, {"message": null}]}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": [{"message": 5}]}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": [5]}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": [null]}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": [{"type": 5}]}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": [{"type": 0, "severity": false}]}', (7, 1, "model"), (7, 1, "model")),
    ('{"quality_score": 7, "findings": [{"type": [], "severity": {}}]}', (7, 1, "model"), (7, 1, "model")),
    ('{"quality_score": 7, "findings": [{"file_path": 5}]}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": [{"line_number": 3.0}]}', (7, 1, "model"), (7, 1, "model")),
    ('{"quality_score": 7, "findings": [{"line_number": 3.5}]}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": [{"line_number": "x"}]}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": null}', (7, 0, "model"), (80, 1, "canned")),
    ('{"quality_score": 7, "findings": 5}', (7, 0, "model"), (80, 1, "canned")),
    ('{"quality_score": 7, "findings": ""}', (7, 0, "model"), (7, 0, "model")),
    ('{"quality_score": 7, "findings": {}}', (7, 0, "model"), (7, 0, "model")),
    ('{"quality_score": 7, "findings": "x"}', (7, 0, "model"), (80, 0, "void")),
    ('{"quality_score": 7, "findings": {"a": 1}}', (7, 0, "model"), (80, 0, "void")),
    ('{"quality_score": 7, "plantuml": null}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 7, "plantuml": 5}', (80, 0, "void"), (80, 0, "void")),
    ('{"quality_score": 150}', (100, 0, "model"), (80, 0, "model")),
    ("[1]", (80, 1, "canned"), (80, 1, "canned")),
    ("null", (80, 1, "canned"), (80, 1, "canned")),
    ("5", (80, 1, "canned"), (80, 1, "canned")),
    ("", (80, 0, "model"), (80, 0, "model")),
    (None, (None, None, None), (None, None, None)),
    ("words", (80, 0, "model"), (80, 1, "canned")),
    ('words ```json\n{"quality_score": 9}\n``` words', (9, 0, "model"), (80, 1, "canned")),
    ("```json\n[1]\n```", (80, 1, "canned"), (80, 1, "canned")),
    ('```json {"quality_score": 9}', (80, 0, "model"), (80, 1, "canned")),
]


@pytest.mark.parametrize("mode", responses.MODES)
def test_odd_responses(spark, mode):
    df = spark.createDataFrame([(i, o[0]) for i, o in enumerate(ODD)], "i int, raw string")
    got = responses.review_responses(df, mode=mode).orderBy("i").collect()
    shown = [(r.quality_score, None if r.findings is None else len(r.findings), r.source) for r in got]
    want = [o[1 if mode == "fenced" else 2] for o in ODD]
    assert [(ODD[i][0], s) for i, s in enumerate(shown)] == [(ODD[i][0], w) for i, w in enumerate(want)]


def test_lenient_drops_the_bad_element_alone(spark):
    df = spark.createDataFrame([('{"quality_score": 7, "findings": [{"message": "a"}, 5, {"message": "b"}]}',)], "raw string")
    r = responses.review_responses(df, bad="lenient").first()
    assert (r.quality_score, [(f.ordinal, f.message) for f in r.findings]) == (7, [(0, "a"), (2, "b")])


def test_default_and_empty_diagram(spark):
    df = spark.createDataFrame([(0, "{}"), (1, '{"plantuml": ""}'), (2, '{"plantuml": 1}')], "i int, raw string")
    got = [r.plantuml for r in responses.review_responses(df).orderBy("i").collect()]
    assert got == [fixed.DEFAULT_DIAGRAM, "", fixed.EMPTY_DIAGRAM]


def requests(spark, *jobs):
    return spark.createDataFrame([(j, "o/r", 1, "sha") for j in jobs], "job_id string, repo string, pr_number int, commit_sha string")


def test_run_reviews(spark):
    raw = spark.createDataFrame([
        ("a", '{"quality_score": 55, "findings": [{"type": "Security", "severity": "HIGH", "message": "m", "file_path": "", "line_number": 0}]}'),
    ], "job_id string, raw string")
    joined = responses.join_responses(requests(spark, "a", "b"), responses.review_responses(raw))
    run = responses.run_reviews(joined, F.lit("2024-01-01").cast("timestamp"))
    assert rows(run.reviews, "job_id", "status", "quality_score") == [("a", "done", 55), ("b", "done", 85)]
    ids = dict(run.reviews.select("job_id", "id").collect())
    stored = [r for r in run.findings.collect() if r.review_id == ids["a"]]
    assert [(r.type, r.severity, r.file_path, r.line_number) for r in stored] == [("code_smell", "high", None, None)]
    shown = [r.type for r in run.shown.collect() if r.review_id == ids["a"]]
    assert shown == ["security_issue"]
    assert run.findings.count() == 1 + len(fixed.UNREACHABLE_RESPONSE["findings"])
    assert rows(telemetry.reviews_total(run.events)) == [("orchestrator", "done", 2)]


def test_null_type_fails_the_review(spark):
    answered = responses.review_responses(spark.createDataFrame([("a", '{"findings": [{}]}')], "job_id string, raw string"))
    untyped = answered.withColumn("findings", F.transform("findings", lambda f: f.withField("type", F.lit(None).cast("string"))))
    run = responses.run_reviews(responses.join_responses(requests(spark, "a"), untyped), F.lit("2024-01-01").cast("timestamp"))
    r = run.reviews.first()
    assert (r.status, r.quality_score, r.completed_at, run.findings.count()) == ("failed", None, None, 0)


# Telemetry, artifacts, scoring

def test_histogram_is_monotone(spark):
    df = telemetry.latency_histogram(V.latency(spark, SF), ("status",))
    order = [*map(str, fixed.LATENCY_BOUNDS_MS), "+Inf"]
    per = {}
    for r in df.collect():
        per.setdefault(r.status, {})[r.le] = r
    for buckets in per.values():
        counts = [buckets[le].bucket_count for le in order]
        assert counts == sorted(counts)
        assert counts[-1] == buckets["+Inf"].latency_count


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(100,), (101,), (30000,), (30001,)], "latency_ms int")
    got = dict(telemetry.latency_histogram(df).select("le", "bucket_count").collect())
    assert got == {"100": 1, "500": 2, "1000": 2, "2000": 2, "5000": 2, "10000": 2, "30000": 3, "+Inf": 4}


def test_artifacts(spark):
    df = spark.sql("select 'j' job_id, timestamp'2024-01-01' ts, 'abcdefghi' suffix, cast(null as string) plantuml")
    got = artifacts.artifacts(df, "https://store", "b").first()
    assert tuple(got) == ("j", "uml/j.puml", fixed.EMPTY_DIAGRAM, "s3://b/uml/j.puml")


def test_scorer_failures_do_not_fail_the_job(spark):
    def scorer(prompt):
        if "bad" in prompt.split("\n\n")[1]:
            raise RuntimeError("down")
        return '{"quality_score": 42}'

    df = spark.createDataFrame([("a", "good"), ("b", "bad")], "job_id string, diff string")
    scored = scoring.score_diffs(df, ["job_id"], scorer)
    assert rows(scored, "job_id", "raw", "outcome") == [("a", '{"quality_score": 42}', "success"), ("b", None, "error")]
    answered = responses.review_responses(scored)
    assert rows(answered, "job_id", "source", "outcome") == [("a", "model", "success"), ("b", None, "error")]
    joined = responses.join_responses(requests(spark, "a", "b"), answered)
    assert rows(joined, "job_id", "quality_score", "source") == [("a", 42, "model"), ("b", 85, "fallback")]


def test_default_scorer(spark):
    df = spark.createDataFrame([("a", "x")], "job_id string, diff string")
    r = responses.review_responses(scoring.score_diffs(df, ["job_id"])).first()
    assert (r.quality_score, len(r.findings), r.findings[0].type) == (80, 1, "suggestion")

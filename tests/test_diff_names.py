"""Sections found by a name inside their header line, against a line-by-line reading."""

import random
import time

from diffmill.operators import diffs
from diffmill.session import stored

FILE = "repo string, pr_number long, seq int, filename string, status string, is_binary boolean, patch string, head_sha string"


def plain_section(diff, name):
    """Lines of the first run of sections whose header line holds the name."""
    lines, inside = [], False
    for line in diff.split("\n"):
        if "diff --git" in line and name in line:
            inside = True
            lines.append(line)
        elif inside and line.startswith("diff --git"):
            break
        elif inside:
            lines.append(line)
    return "\n".join(lines) if lines else None


def random_diff(rng, names):
    lines = []
    for _ in range(rng.randrange(0, 14)):
        name = rng.choice(names)
        lines.append(rng.choice(["", " ", "x "] if rng.random() < 0.2 else [""]) + f"diff --git a/{name} b/{name}")
        lines += [rng.choice(["+a", "-b", "", f"see {name}", "@@"]) for _ in range(rng.randrange(3))]
    if rng.random() < 0.3:
        lines.insert(0, "preamble")
    return "\n".join(lines)


NAMES = ["a", "a.js", "b/a.js", "b/a.jsx", "src/b/a.js", "é.js", "git", "--git a/", "diff --git", "zz", ""]


def test_names_against_a_reading_line_by_line(spark):
    rng = random.Random(31)
    prs = [(f"r{i % 3}", i, random_diff(rng, NAMES[:-1])) for i in range(120)] + [("r0", 500, ""), ("r0", 501, "diff --git")]
    files, want = [], {}
    for repo, number, diff in prs:
        for seq in range(rng.randrange(1, 9)):
            name = rng.choice([*NAMES, None])
            files.append((repo, number, seq, name, "modified", False, None, "sha"))
            part = None if name is None else plain_section(diff, name)
            if part is not None:
                want[repo, number, seq] = part
    prs = spark.createDataFrame(prs, "repo string, pr_number long, diff string")
    contents = spark.createDataFrame([], "repo string, sha string, path string, content string")
    for slice_names in (1, 3, 20_000):
        found = diffs.diff_parts(prs, spark.createDataFrame(files, FILE), contents, "contains", slice_names)
        got = {(r.repo, r.pr_number, r.seq): r.part for r in found.collect()}
        assert got == want and len(want) > 200


def test_automaton_reads_many_names_in_near_linear_time():
    def seconds(n):
        names = [f"src/m{i}/file{i}.js" for i in range(n)]
        heads = [f"diff --git a/{x} b/{x}" for x in names]
        began = time.perf_counter()
        runs = diffs.name_runs(names, heads)
        assert {r["name"]: (r["first"], r["last"]) for r in runs} == {i: (i + 1, i + 1) for i in range(n)}
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.02)


def test_one_pull_request_of_many_files(spark):
    n = 100_000
    ids = spark.range(n).selectExpr("cast(id as int) as seq", "concat('src/m', id, '/f', id, '.js') as filename")
    section = "concat('diff --git a/x/', filename, ' b/x/', filename, '\n+', seq)"
    prs = ids.selectExpr(f"struct(seq, {section} as s) as e").groupBy().agg({"e": "collect_list"}).toDF("es")
    prs = prs.selectExpr("'r' as repo", "7L as pr_number", "array_join(transform(sort_array(es), e -> e.s), '\n') as diff")
    files = ids.selectExpr(
        "'r' as repo", "7L as pr_number", "seq", "filename", "'modified' as status", "false as is_binary",
        "cast(null as string) as patch", "'sha' as head_sha",
    )
    contents = spark.createDataFrame([], "repo string, sha string, path string, content string")
    prs, files = stored(prs, "prs"), stored(files, "files")
    parts = diffs.diff_parts(prs, files, contents, "contains")
    wrong = "not (part like concat('diff --git a/x/src/m', seq, '/%\n+', seq))"
    assert parts.count() == n and parts.where(wrong).count() == 0
    plan = parts._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

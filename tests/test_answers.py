"""Calls of a scorer: in order, several at a time, and once for each prompt."""

import time

from diffmill.operators import scoring
from diffmill.session import work_dir

DIFFS = "job_id int, diff string"


def scored(spark, rows, scorer, **how):
    found = scoring.score_diffs(spark.createDataFrame(rows, DIFFS), ["job_id"], scorer, **how)
    return sorted((r.job_id, r.raw, r.outcome) for r in found.collect())


def calls_in(folder):
    """A scorer that leaves a file for each call, and the number of those files."""
    folder.mkdir()
    where = str(folder)

    def scorer(prompt):
        import uuid
        from pathlib import Path

        Path(where, uuid.uuid4().hex).touch()
        if "bad" in prompt.split("\n\n")[1]:
            raise ValueError("down")
        return str(len(prompt))

    return scorer, lambda: len(list(folder.iterdir()))


def test_equal_prompts_are_asked_once_and_kept(spark, tmp_path):
    scorer, calls = calls_in(tmp_path / "calls")
    answers = f"{work_dir(spark, 'answers')}/table"
    rows = [(i, ["one", "two", "bad", None][i % 4]) for i in range(200)]
    first = scored(spark, rows, scorer, answers=answers)
    plain, _ = calls_in(tmp_path / "plain")
    assert first == scored(spark, rows, plain) and calls() == 3  # a missing diff is not asked
    again = scored(spark, [*rows, (999, "three")], scorer, answers=answers)
    # only the new prompt and the one that failed are asked again
    assert calls() == 3 + 2 and [r for r in again if r[0] < 200] == first
    assert again[-1] == (999, plain_answer("three"), "success")
    kept = scoring.read_answers(spark, answers)
    assert kept.count() == 3 and kept.where("outcome <> 'success'").count() == 0


def plain_answer(diff):
    from diffmill.fixed import PROMPT_AFTER, PROMPT_BEFORE

    return str(len(PROMPT_BEFORE + diff + PROMPT_AFTER))


def test_overlapping_runs_leave_one_answer(spark):
    answers = f"{work_dir(spark, 'answers')}/table"
    for k in (1, 2):
        one = spark.createDataFrame([("h", f"raw{k}", "custom", "success", 1)], "prompt_hash string, raw string, scorer string, outcome string, latency_ms int")
        one.withColumn("latency_ms", one.latency_ms.cast("decimal(18,2)")).write.parquet(f"{answers}/run={k}")
    assert [r.raw for r in scoring.read_answers(spark, answers).collect()] == ["raw1"]


def test_calls_run_side_by_side_and_stay_in_order():
    running, most = [], []

    def slow(text):
        running.append(text)
        most.append(len(running))
        time.sleep(0.02)
        running.remove(text)
        return text.upper()

    texts = [f"t{i}" for i in range(40)]
    began = time.perf_counter()
    got = list(scoring._calls(slow, texts, 5.0, 8))
    assert [r[0] for r in got] == [t.upper() for t in texts] and {r[1] for r in got} == {"success"}
    assert 2 <= max(most) <= 8 and time.perf_counter() - began < 0.6


def test_hanging_calls_cost_their_limit_only():
    def scorer(text):
        if text == "hang":
            time.sleep(1.5)
        return text

    got = list(scoring._calls(scorer, ["a", "hang", "b", "hang", "c"], 0.3, 2))
    assert [r[:2] for r in got] == [("a", "success"), (None, "error"), ("b", "success"), (None, "error"), ("c", "success")]

"""Scoring of diffs through a pluggable scorer."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.fixed import CANNED_RESPONSE
from diffmill.functions.text import prompt
from diffmill.session import exists, stored

Scorer = Callable[[str], str]
# Longest wait for the answer to one call, and calls of a task that run at a time.
CALL_LIMIT_S = 30.0
CONCURRENCY = 8


def score_diffs(
    df: DataFrame, keys: list[str], scorer: Scorer | None = None, diff: str = "diff", limit_s: float = CALL_LIMIT_S,
    concurrency: int = CONCURRENCY, answers: str | None = None,
) -> DataFrame:
    """Raw response text per diff (X1): keys, ``raw``, ``scorer``, ``outcome``, ``latency_ms``.

    Without a scorer every diff gets the fixed response, as a literal. A scorer takes a
    prompt and returns the response text; it runs in Python workers, ``concurrency`` calls
    of a task at a time. A row it fails on, or has no answer for within ``limit_s``
    seconds, gets NULL and ``error``, and the job goes on; ``with_fallback`` fills it in later.

    With ``answers``, the folder of an answer table, equal prompts are asked once: answers are
    kept by the hash of their prompt, only hashes without one are asked, and rows take the
    answer of their hash. Failures are not kept, so the next run asks again.
    """
    if scorer is None:
        return df.select(
            *keys,
            F.lit(json.dumps(CANNED_RESPONSE)).alias("raw"),
            F.lit("default").alias("scorer"),
            F.lit("success").alias("outcome"),
            F.lit(0).cast("decimal(18,2)").alias("latency_ms"),
        )
    asked = df.select(*keys, prompt(F.col(diff)).alias("_prompt"))
    if answers is None:
        return _asked(asked, scorer, limit_s, concurrency)
    hashed = asked.withColumn("prompt_hash", F.sha2("_prompt", 256))
    known = read_answers(df.sparkSession, answers)
    open_prompts = hashed.where("prompt_hash is not null").groupBy("prompt_hash").agg(F.first("_prompt").alias("_prompt"))
    if known is not None:
        open_prompts = open_prompts.join(known, "prompt_hash", "left_anti")
    # written down before it is used, so that a lost task asks nobody again
    spread = open_prompts.repartition(df.sparkSession.sparkContext.defaultParallelism)
    new = stored(_asked(spread, scorer, limit_s, concurrency), "answers")
    new.where("outcome = 'success'").write.parquet(f"{answers}/run={uuid.uuid4().hex}")
    answered = new if known is None else new.unionByName(known)
    rows = hashed.select(*keys, "prompt_hash").join(answered, "prompt_hash", "left")
    nothing = {"scorer": F.lit("custom"), "outcome": F.lit("error"), "latency_ms": F.lit(0).cast("decimal(18,2)")}
    return rows.withColumns({c: F.coalesce(c, x) for c, x in nothing.items()}).drop("prompt_hash")  # no prompt, no call


def read_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """Kept answers, one per prompt hash; None where there are none yet. Of answers of runs that overlapped one holds."""
    if not exists(spark, path):
        return None
    first = F.min(F.struct("raw", "scorer", "outcome", "latency_ms")).alias("_first")
    return spark.read.parquet(path).groupBy("prompt_hash").agg(first).select("prompt_hash", "_first.*")


def _asked(asked: DataFrame, scorer: Scorer, limit_s: float, concurrency: int) -> DataFrame:
    kept = [f for f in asked.schema.fields if f.name != "_prompt"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answered = list(_calls(scorer, batch.pop("_prompt"), limit_s, concurrency))
            batch["raw"] = [r[0] for r in answered]
            batch["scorer"] = "custom"
            batch["outcome"] = [r[1] for r in answered]
            batch["latency"] = [r[2] for r in answered]
            yield batch

    scored = asked.mapInPandas(run, f"{shape}, raw string, scorer string, outcome string, latency double")
    return scored.withColumn("latency_ms", F.col("latency").cast("decimal(18,2)")).drop("latency")


def _calls(scorer: Scorer, prompts: Iterable[str], limit_s: float, concurrency: int) -> Iterator[tuple[str | None, str, float]]:
    """Answer, outcome and milliseconds of each prompt, in order; at most ``concurrency`` calls run."""

    def call(text: str) -> tuple[str | None, str, float]:
        began = time.perf_counter()
        try:
            raw, outcome = scorer(text), "success"
        except Exception:
            raw, outcome = None, "error"
        return raw, outcome, (time.perf_counter() - began) * 1000

    pool, waiting = ThreadPoolExecutor(concurrency), deque()

    def answer(future: Future, began: float) -> tuple[str | None, str, float]:
        nonlocal pool
        try:
            return future.result(max(0.0, began + limit_s - time.perf_counter()))
        except TimeoutError:
            # the call hangs and keeps its thread, so the next ones need others
            future.cancel()
            pool.shutdown(wait=False)
            pool = ThreadPoolExecutor(concurrency)
            return None, "error", (time.perf_counter() - began) * 1000

    for text in prompts:
        if len(waiting) >= concurrency:
            yield answer(*waiting.popleft())
        waiting.append((pool.submit(call, text), time.perf_counter()))
    while waiting:
        yield answer(*waiting.popleft())
    pool.shutdown(wait=False)

"""Reviews and findings: look up, join, rank, count and maintain."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill.fixed import SEVERITIES, STATUSES
from diffmill.functions.json import uml_url
from diffmill.functions.normalize import score_band, severity_rank
from diffmill.plans.paging import attach_by_key, number_pages, split_by_size

ORDINAL = ("ordinal",)


# Projections and look-ups

def review_list(reviews: DataFrame) -> DataFrame:
    """Columns of the review list (P10)."""
    return reviews.select("id", "repo", "pr_number", "status", "quality_score", "created_at")


def latest_reviews(reviews: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first, the first ``n`` if given."""
    newest = reviews.orderBy(F.col("created_at").desc(), F.col("id"))
    return newest if n is None else newest.limit(n)


def leading_int(text: Column) -> Column:
    """Leading integer of a text, NULL without one."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def by_id(df: DataFrame, wanted: str | int, column: str = "id") -> DataFrame:
    """Rows of one numeric id; the text form counts up to its last leading digit."""
    found = re.match(r"\s*([+-]?[0-9]+)", str(wanted))
    if found is None:
        raise ValueError("Invalid review ID")
    return df.where(F.col(column) == int(found.group(1)))


def by_job(df: DataFrame, job_id: str) -> DataFrame:
    """Rows of one job."""
    return df.where(F.col("job_id") == job_id)


def by_ids(df: DataFrame, wanted: DataFrame, text: str, column: str = "id") -> DataFrame:
    """Bulk form of ``by_id``: rows of every id in a column of texts."""
    keys = wanted.select(leading_int(F.col(text)).alias(column)).where(F.col(column).isNotNull())
    return df.join(keys.distinct(), column, "left_semi")


def new_reviews(requests: DataFrame, status: str, at: Column) -> DataFrame:
    """Review rows of requests, created ``at``."""
    if status not in STATUSES:
        raise ValueError(f"status is one of {STATUSES}")
    return assign_ids(requests, ["job_id"]).select(
        "id",
        "job_id",
        "repo",
        "pr_number",
        "commit_sha",
        F.lit(status).alias("status"),
        F.lit(None).cast("int").alias("quality_score"),
        F.lit(None).cast("string").alias("static_metrics"),
        F.lit(None).cast("string").alias("github_comment_id"),
        at.alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )


def sha_matches(head: Column, sha: Column) -> Column:
    """Whether the checked-out commit is the requested one."""
    return F.regexp_replace(head, r"^\s+|\s+$", "") == sha


def assign_ids(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """Surrogate key from the natural one: the same on every replay and computed
    without a sequence (K1). ``id_collisions`` lists keys that share one."""
    return df.withColumn(name, F.xxhash64(*keys))


def id_collisions(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """Ids given to more than one natural key, with the number of keys (K1)."""
    pairs = df.select(name, *keys).distinct()
    return pairs.groupBy(name).agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") > 1)


def first_per_job(requests: DataFrame, order: list[str], key: str = "job_id") -> DataFrame:
    """First request of every job, with the number of deliveries. Combined before the
    shuffle, so many copies of one job cost one row per task."""
    rest = [c for c in requests.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return (
        requests.groupBy(key)
        .agg(first.alias("_first"), F.count(F.lit(1)).alias("deliveries"))
        .select(key, "_first.*", "deliveries")
    )


# Ranking

def severity_order(ordinal: tuple[str, ...] = ORDINAL) -> list[Column]:
    """Most severe first, then in the order of the model."""
    return [severity_rank(F.col("severity")).desc(), *[F.col(c).asc() for c in ordinal]]


def detail_order(ordinal: tuple[str, ...] = ORDINAL) -> list[Column]:
    """Most severe first, then newest, then in the order of the model. The rank
    decides, never the text of the severity."""
    first, *rest = severity_order(ordinal)
    return [first, F.col("created_at").desc_nulls_last(), *rest]


def order_findings(findings: DataFrame, ordinal: tuple[str, ...] = ORDINAL) -> DataFrame:
    """Findings of every review in display order."""
    return findings.orderBy(F.col("review_id"), *detail_order(ordinal))


def top_findings(findings: DataFrame, k: int, key: str = "review_id", ordinal: tuple[str, ...] = ORDINAL) -> DataFrame:
    """The k most severe findings of every review, numbered from 1.

    Spark keeps only k rows per review and task before the shuffle, so a review of
    any size sends few rows.
    """
    best = Window.partitionBy(key).orderBy(*severity_order(ordinal))
    return findings.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)


# Joins

_DETAIL = ("type", "severity", "file_path", "line_number", "message", "suggestion", "created_at")


def review_detail(
    reviews: DataFrame, findings: DataFrame, ordinal: tuple[str, ...] = ORDINAL, page_findings: int = 50_000,
    placed: bool = False,
) -> DataFrame:
    """Reviews with their findings nested in display order.

    A review without findings gets an empty array. One of more than
    ``page_findings`` comes as several rows with ascending ``page``. ``placed`` says
    that the findings are stored by review, so that they need not be dealt out.
    """
    heads = reviews.withColumn("uml_s3_url", uml_url(F.col("static_metrics"))).drop("static_metrics")
    fields = [c for c in ("id", *_DETAIL) if c in findings.columns]
    groups = split_by_size(findings, ["review_id"], page_findings)
    first = groups.small.withColumn("page", F.lit(0).cast("bigint"))
    whole = _nested(first if placed else first.repartition("review_id"), fields, ordinal)
    small_heads = heads
    if groups.large is not None:
        keys = groups.large_keys.withColumnRenamed("review_id", "id")
        small_heads = attach_by_key(heads, keys, ["id"], "left_anti")
    empty = F.array().cast(whole.schema["findings"].dataType)
    detail = (
        small_heads.join(whole, heads["id"] == whole["review_id"], "left")
        .drop("review_id")
        .withColumn("findings", F.coalesce("findings", empty))
        .withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
    )
    if groups.large is None:
        return detail
    numbered = number_pages(groups.large, ["review_id"], detail_order(ordinal), page_findings)
    pages = _nested(numbered.repartition("review_id", "page"), fields, ordinal)
    large_heads = attach_by_key(heads, keys, ["id"], "left_semi")
    return detail.unionByName(pages.join(large_heads, pages["review_id"] == large_heads["id"], "inner").drop("review_id"))


def _nested(paged_findings: DataFrame, fields: list[str], ordinal: tuple[str, ...]) -> DataFrame:
    """Pages as arrays. The rows come partitioned already: gathering them before the
    shuffle would save nothing."""
    newest = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(2**63 - 1))
    sort_key = F.struct((-severity_rank(F.col("severity"))).alias("r"), newest.alias("t"), *ordinal)
    entry = F.struct(sort_key.alias("k"), F.struct(*fields).alias("v"))
    ordered = F.sort_array(F.collect_list(entry))
    return paged_findings.groupBy("review_id", "page").agg(F.transform(ordered, lambda e: e["v"]).alias("findings"))


def attach_review_id(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the key of their review in place of the job id."""
    keys = reviews.select("job_id", F.col("id").alias("review_id"))
    return findings.join(keys, "job_id", "inner").drop("job_id")


def latest_static(results: DataFrame, order: str = "offset_no") -> DataFrame:
    """Last static result of every job; combined before the shuffle."""
    last = F.max_by("static_metrics", order).alias("static_metrics")
    return results.groupBy("job_id").agg(last, F.max(order).alias(order))


def apply_static(reviews: DataFrame, results: DataFrame, order: str = "offset_no") -> tuple[DataFrame, DataFrame]:
    """Reviews with their last static metrics, and results without a review."""
    last = latest_static(results, order).select("job_id", F.col("static_metrics").alias("_new"))
    updated = (
        reviews.join(last, "job_id", "left")
        .withColumn("static_metrics", F.coalesce("_new", "static_metrics"))
        .drop("_new")
        .select(reviews.columns)
    )
    return updated, results.join(reviews.select("job_id"), "job_id", "left_anti")


def delete_jobs(reviews: DataFrame, findings: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of reviews and findings without the given jobs."""
    gone = jobs.select("job_id").distinct()
    doomed = reviews.join(gone, "job_id", "left_semi").select(F.col("id").alias("review_id"))
    return reviews.join(gone, "job_id", "left_anti"), findings.join(doomed, "review_id", "left_anti")


def reconcile(requests: DataFrame, reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """How far each published job got: published, review, static_metrics, findings,
    done or failed (J7). A request that was delivered again counts once."""
    rows = reviews.select("job_id", F.col("id").alias("review_id"), "status", "static_metrics").join(
        findings_count(findings), "review_id", "left"
    )
    stage = (
        F.when(F.col("review_id").isNull(), "published")
        .when(F.col("status").isin("done", "failed"), F.col("status"))
        .when(F.col("findings") > 0, "findings")
        .when(F.col("static_metrics").isNotNull(), "static_metrics")
        .otherwise("review")
    )
    return (
        requests.select("job_id")
        .distinct()
        .join(rows, "job_id", "left")
        .fillna(0, ["findings"])
        .select("job_id", stage.alias("stage"), F.col("static_metrics").isNotNull().alias("has_static"), "findings")
    )


# Counts

def status_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per status (A3)."""
    return reviews.groupBy("status").agg(F.count(F.lit(1)).alias("reviews"))


def score_bands(reviews: DataFrame) -> DataFrame:
    """Reviews per score band."""
    return reviews.groupBy(score_band(F.col("quality_score")).alias("band")).agg(F.count(F.lit(1)).alias("reviews"))


def findings_count(findings: DataFrame) -> DataFrame:
    """Findings per review."""
    return findings.groupBy("review_id").agg(F.count(F.lit(1)).alias("findings"))


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Findings per type, one column for each severity."""
    per = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    return findings.groupBy("type").agg(*per, F.count(F.lit(1)).alias("findings"))


def quality_trend(reviews: DataFrame, grain: str = "day") -> DataFrame:
    """Scored reviews, mean score and bands per repository and period (A10)."""
    score = F.col("quality_score")
    band = score_band(score)
    return (
        reviews.where(score.isNotNull())
        .groupBy("repo", F.date_trunc(grain, F.col("created_at")).alias("period"))
        .agg(
            F.count(F.lit(1)).alias("reviews"),
            F.sum(score).alias("score_sum"),
            (F.sum(score) / F.count(score)).alias("mean_score"),
            *[F.count(F.when(band == b, 1)).alias(b) for b in ("good", "fair", "poor")],
        )
    )


def out_of_domain(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Values of a column outside its domain, with their number; NULL is one too."""
    strange = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(strange).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# Maintenance

def upsert(base: DataFrame, changes: DataFrame, key: str, cols: list[str], order: list[str] | None = None) -> DataFrame:
    """``base`` with ``cols`` replaced where ``changes`` has the key (S6). Of several
    changes to a key the last by ``order`` holds (without one: the greatest values);
    they are combined before the shuffle."""
    last = F.max_by(F.struct(*cols), F.struct(*(order or cols))).alias("_last")
    folded = changes.groupBy(key).agg(last)
    new = folded.select(key, *[F.col(f"_last.{c}").alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = base.join(new, key, "left")
    replaced = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.withColumns(replaced).select(base.columns)


def review_state(events: DataFrame) -> DataFrame:
    """Fold an event log to the last state of each job (ST4).

    ``completed_at`` is set by ``done`` only. Works on a batch or, in update mode, on
    a stream.
    """
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "seq"))
    return (
        events.groupBy("job_id")
        .agg(last.alias("_last"), F.min("ts").alias("created_at"))
        .select(
            "job_id",
            "created_at",
            F.col("_last.status").alias("status"),
            F.when(F.col("_last.status") == "done", F.col("_last.ts")).alias("completed_at"),
        )
    )

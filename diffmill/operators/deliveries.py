"""Webhook deliveries: check, unpack and classify."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill.functions.json import field, is_array, is_object, once, text_field, with_json
from diffmill.functions.normalize import is_missing
from diffmill.functions.signature import signature_state


def pull_requests(df: DataFrame) -> DataFrame:
    """Pull-request events only."""
    return df.where(F.col("event") == "pull_request")


def extract_pr(df: DataFrame) -> DataFrame:
    """Repository, number, commits and inline diff of the payload.

    Every part may be missing. ``inline_diff`` is set only where the payload has a
    non-empty JSON string there.
    """
    doc = F.col("_doc")
    return (
        with_json(df, "_doc", F.col("raw_body"))
        .withColumns({
            "repo": field(doc, "repository.full_name", "string"),
            "pr_number": field(doc, "pull_request.number", "int"),
            "head_sha": field(doc, "pull_request.head.sha", "string"),
            "base_sha": field(doc, "pull_request.base.sha", "string"),
            "inline_diff": F.nullif(text_field(doc, "diff"), F.lit("")),
            "readable": is_object(doc) | is_array(doc),
        })
        .drop("_doc")
    )


def missing_fields(df: DataFrame, cols: list[str]) -> Column:
    """Whether any required field is NULL, '' or 0 (P5)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    checks = [is_missing(F.col(c), isinstance(types[c], T.NumericType)) for c in cols]
    return reduce(lambda a, b: a | b, checks)


def classify_delivery(df: DataFrame, secret: str) -> DataFrame:
    """Outcome and HTTP status of each delivery.

    The body is read before anything is checked, so an unreadable one is refused
    first; then signature, event and required fields decide, in this order.
    """
    fields = extract_pr(df)
    missing = missing_fields(fields, ["repo", "pr_number", "head_sha"])
    state = F.col("signature_state")
    unreadable = ~F.col("readable") & F.coalesce(F.col("raw_body") != "", F.lit(False))
    outcome = (
        F.when(unreadable, "unreadable_body")
        .when(state == "missing", "no_signature")
        .when(state != "valid", "invalid_signature")
        .when(~F.col("event").eqNullSafe(F.lit("pull_request")), "ignored")
        .when(missing, "missing_fields")
        .otherwise("accepted")
    )
    status = (
        F.when(F.col("outcome").isin("no_signature", "invalid_signature"), 401)
        .when(F.col("outcome") == "ignored", 200)
        .when(F.col("outcome").isin("missing_fields", "unreadable_body"), 400)
        .otherwise(202)
    )
    checked = signature_state(F.col("raw_body"), F.col("signature"), secret)
    return (
        once(fields, signature_state=checked)
        .withColumn("outcome", outcome)
        .withColumn("http_status", status)
        .drop("readable")
    )


def accepted_deliveries(df: DataFrame, secret: str) -> DataFrame:
    """Accepted deliveries only. What the scan can tell apart is dropped there, before
    any body is parsed or hashed."""
    likely = pull_requests(df).where(F.col("signature").startswith("sha256="))
    return classify_delivery(likely, secret).where(F.col("outcome") == "accepted")


def resolve_diff(inline: Column, rebuilt: Column, original: Column) -> Column:
    """Inline diff, else the rebuilt one, else the original."""
    return F.coalesce(F.nullif(inline, F.lit("")), F.nullif(rebuilt, F.lit("")), original)


def job_key(*parts: Column) -> Column:
    """A job id that a replay of the same delivery gives again."""
    return F.md5(F.concat_ws("\x1f", *parts))


def review_requests(accepted: DataFrame, diff: Column | None = None) -> DataFrame:
    """Request messages of accepted deliveries."""
    keyed = job_key(F.col("repo"), F.col("pr_number").cast("string"), F.col("head_sha"), F.col("raw_body"))
    return accepted.select(
        keyed.alias("job_id"),
        "repo",
        "pr_number",
        F.col("head_sha").alias("commit_sha"),
        (F.col("inline_diff") if diff is None else diff).alias("diff"),
    )


def parse_messages(df: DataFrame, schema: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Readable messages, and a quarantine of the others with a reason."""
    sorted_out = tag_messages(df, schema, value)
    names = [f.name for f in schema.fields]
    kept = [c for c in df.columns if c not in names and c != value]
    good = sorted_out.where(F.col("reason").isNull()).select(*kept, *[F.col(f"_msg.{n}") for n in names])
    return good, sorted_out.where(F.col("reason").isNotNull()).select(*df.columns, "reason")


def tag_messages(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Each message with its fields in ``_msg`` and, if unusable, a ``reason``."""
    text = F.col(value).cast("string")
    doc = F.col("_doc")
    parts = [field(doc, f.name, f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    reason = F.when(text.isNull() | (text == ""), "blank").when(~is_object(doc), "malformed")
    return (
        with_json(df, "_doc", text)
        .withColumn("reason", reason)
        .withColumn("_msg", F.struct(*parts))
        .drop("_doc")
    )

"""Rendered review comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.fixed import (
    COMMENT_HEADING,
    COMMENT_LIST_HEADING,
    COMMENT_NO_ISSUES,
    COMMENT_RULE,
    COMMENT_SCORE,
    COMMENT_SIGNATURE,
    COMMENT_SUGGESTION,
)
from diffmill.functions.normalize import location, null_if_falsy, type_label
from diffmill.operators.reviews import ORDINAL, top_findings


def finding_text(position: Column) -> Column:
    """One numbered finding of a comment."""
    where = location(F.col("file_path"), F.col("line_number"))
    suggestion = null_if_falsy(F.col("suggestion"))
    return F.concat(
        position.cast("string"),
        F.lit(". **"),
        type_label(F.col("type")),
        F.lit("** "),
        F.when(where != "", F.concat(F.lit("("), where, F.lit(") "))).otherwise(""),
        F.lit("- "),
        F.col("message"),
        F.coalesce(F.concat(F.lit(COMMENT_SUGGESTION), suggestion), F.lit("")),
        F.lit("\n\n"),
    )


def render_comment(
    reviews: DataFrame,
    findings: DataFrame,
    k: int = 3,
    ordinal: tuple[str, ...] = ORDINAL,
    signature: str = COMMENT_SIGNATURE,
) -> DataFrame:
    """Reviews with the comment ``body`` (R1): score, up to k findings, signature.

    At most k findings per review reach the shuffle and the ordered concatenation.
    """
    top = top_findings(findings, k, ordinal=ordinal)
    lines = top.groupBy("review_id").agg(
        F.sort_array(F.collect_list(F.struct("position", finding_text(F.col("position")).alias("text")))).alias("_lines")
    )
    listed = F.array_join(F.transform("_lines", lambda x: x["text"]), "")
    before, after = COMMENT_SCORE
    body = F.concat(
        F.lit(COMMENT_HEADING + before),
        F.coalesce(F.col("quality_score").cast("string"), F.lit("null")),
        F.lit(after),
        F.coalesce(F.concat(F.lit(COMMENT_LIST_HEADING), listed), F.lit(COMMENT_NO_ISSUES)),
        F.lit(COMMENT_RULE + signature),
    )
    joined = reviews.join(lines, reviews["id"] == lines["review_id"], "left")
    return joined.withColumn("body", body).drop("review_id", "_lines")


def comment_outbox(
    reviews: DataFrame, findings: DataFrame, sent: DataFrame | None = None, **rendering
) -> DataFrame:
    """Comments of finished reviews that were not sent yet.

    A review counts as sent once it has a comment id or is in ``sent`` (column id).
    """
    due = reviews.where((F.col("status") == "done") & F.col("github_comment_id").isNull())
    if sent is not None:
        due = due.join(sent.select("id"), "id", "left_anti")
    return render_comment(due, findings, **rendering).select("id", "repo", "pr_number", "body")

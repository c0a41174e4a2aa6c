"""Diagram artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.fixed import EMPTY_DIAGRAM
from diffmill.functions.naming import artifact_key, artifact_url


def artifacts(df: DataFrame, endpoint: str, bucket: str) -> DataFrame:
    """Key, body and address of each diagram (S9): needs job_id, ts, suffix, plantuml."""
    keyed = df.select(
        "job_id",
        artifact_key(F.col("job_id"), F.col("ts"), F.col("suffix")).alias("key"),
        F.coalesce("plantuml", F.lit(EMPTY_DIAGRAM)).alias("body"),
    )
    return keyed.withColumn("url", artifact_url(F.col("key"), endpoint, bucket))

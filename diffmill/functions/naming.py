"""Names and addresses of repositories and diagram artifacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_url(repo: Column) -> Column:
    """Clone address; a short ``owner/name`` gets the public host."""
    full = repo.rlike("^(https?://|git@)")
    return F.when(full, repo).otherwise(F.concat(F.lit("https://github.com/"), repo, F.lit(".git")))


def artifact_key(job: Column, ts: Column, suffix: Column) -> Column:
    """``uml/<job>.puml``, else a timestamp and eight characters of ``suffix``."""
    stamped = F.concat(F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(suffix, 1, 8))
    return F.concat(F.lit("uml/"), F.coalesce(F.nullif(job, F.lit("")), stamped), F.lit(".puml"))


def artifact_url(key: Column, endpoint: str, bucket: str) -> Column:
    """Path under a local endpoint, else an ``s3://`` address."""
    base = f"{endpoint}/{bucket}/" if endpoint and "localhost" in endpoint else f"s3://{bucket}/"
    return F.concat(F.lit(base), key)

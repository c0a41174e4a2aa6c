"""Reviews and findings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, where: str, schema: T.StructType | None = None, **jdbc: str) -> DataFrame:
    """A table under a path, or over JDBC when ``where`` is a ``jdbc:`` address.

    JDBC reads need ``dbtable`` and split by id with partitionColumn, lowerBound,
    upperBound and numPartitions.
    """
    if where.startswith("jdbc:"):
        return spark.read.format("jdbc").option("url", where).options(**jdbc).load()
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(where)


def write_reviews(df: DataFrame, path: str, mode: str = "append") -> None:
    """Reviews by day of creation, so that lists and updates touch few folders."""
    dated = df.withColumn("created_on", F.to_date("created_at"))
    _spread(dated).write.mode(mode).partitionBy("created_on").parquet(path)


def write_findings(df: DataFrame, path: str, mode: str = "append") -> None:
    """Findings by day; inside a file by review, so that row groups can be skipped."""
    dated = df.withColumn("created_on", F.to_date("created_at"))
    sorted_rows = _spread(dated).sortWithinPartitions("created_on", "review_id")
    sorted_rows.write.mode(mode).partitionBy("created_on").parquet(path)


def write_artifacts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Diagrams with their keys and addresses."""
    df.write.mode(mode).parquet(path)


def _spread(dated: DataFrame) -> DataFrame:
    """A day's rows together, in files of even size: a rebalance splits a large day
    over several tasks and merges small ones."""
    return dated.hint("rebalance", F.col("created_on"))


def overwrite_partitions(df: DataFrame, path: str, by: str = "created_on") -> None:
    """Replace only the partitions that ``df`` has rows for."""
    even = df.hint("rebalance", F.col(by))
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_table(
    spark: SparkSession, path: str, changes: DataFrame, key: str, cols: list[str], order: list[str] | None = None
) -> None:
    """Update ``cols`` of stored rows by key, rewriting only the touched days (S6). Of
    several changes to a key the last by ``order`` holds."""
    from diffmill.operators.reviews import upsert

    stored = spark.read.parquet(path)
    touched = stored.join(changes.select(key), key, "left_semi").select("created_on").distinct()
    affected = stored.join(touched, "created_on", "left_semi")
    overwrite_partitions(upsert(affected, changes, key, cols, order), path)

"""Landed webhook deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diffmill.schemas import DELIVERY


def read_deliveries(spark: SparkSession, path: str, form: str = "json", stream: bool = False) -> DataFrame:
    """Event, signature and raw body of each delivery (S8), JSON lines or Parquet."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(DELIVERY).format(form).load(path)

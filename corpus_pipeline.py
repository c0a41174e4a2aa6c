"""From raw documents to shards: reject, deduplicate, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of docs;
the last adds rank, shard and slot, which replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diffmill.llm import decontaminate, mixing, neardup, quality, sharding
from diffmill.llm.common import table
from diffmill.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outlier of their language and source."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with rank in curve order, shard and slot."""
    placed = sharding.shard(docs)
    own = [f"row.`{c}`" for c in docs.columns if c not in ("rank", "shard", "slot")]
    return placed.select(*own, "rank", "shard", "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: SQL cannot express the covariance estimate; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

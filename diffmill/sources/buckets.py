"""Reviews and findings stored by review: bucketed tables that join without a shuffle.

Both tables are written in the same number of buckets by the review's id, so its findings lie in the bucket of the same
number as the review: the shuffle is paid once, on writing. Findings on their way in know the job
id only; they and the keys of reviews are bucketed by that.

A store takes the columns it is given and no others, so give it those that will be read; its files are compressed with zstd.
A bucket is read by one task, so their number follows the number of rows. A review of more findings than a page is stored
apart, in files of even size, and its pages are cut as anywhere else.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.operators.reviews import ORDINAL, review_detail
from diffmill.plans.paging import attach_by_key, checked_broadcast, split_by_size

#: Buckets of a table, if nothing else is said, and most rows of one on average: a task sorts them in memory.
BUCKETS, BUCKET_ROWS = 64, 250_000


def buckets_for(rows: DataFrame, least: int = BUCKETS, bucket_rows: int | None = None) -> int:
    """Buckets for a table: ``least``, doubled until they hold ``bucket_rows`` or fewer on average. Tables that are joined bucket
    by bucket take the number of the largest. Of a stored table without conditions only the footers are read."""
    n, buckets = rows.count(), least
    while n > buckets * (bucket_rows or BUCKET_ROWS):
        buckets *= 2
    return buckets


def write_buckets(df: DataFrame, table: str, path: str, key: str, buckets: int = BUCKETS, order: tuple[str, ...] = ()) -> None:
    """``df`` as a table of files under ``path``, one for each bucket of ``key``, sorted by key and ``order``."""
    placed = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order)
    placed.option("path", path).option("compression", "zstd").format("parquet").mode("overwrite").saveAsTable(table)


@dataclass(frozen=True)
class ReviewStore:
    """Tables of a store. ``large`` is None unless some review has more findings than a page, ``keys`` if they were not asked for."""

    reviews: str
    findings: str
    keys: str | None
    large: str | None
    large_keys: str | None
    page_findings: int


def store_reviews(
    reviews: DataFrame, findings: DataFrame, path: str, buckets: int = BUCKETS, page_findings: int = 50_000,
    with_keys: bool = True,
) -> ReviewStore:
    """Write reviews and findings by review id, and the keys of reviews by job id, which details do without."""
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("reviews", "findings")]
    groups = split_by_size(findings, ["review_id"], page_findings)
    write_buckets(reviews, names[0], f"{path}/reviews", "id", buckets)
    write_buckets(groups.small, names[1], f"{path}/findings", "review_id", buckets)
    names.append(store_keys(reviews, f"{path}/keys", buckets) if with_keys else None)
    large = keys = None
    if groups.large is not None:
        large, keys = f"{path}/large", f"{path}/large_keys"
        groups.large.hint("rebalance").write.parquet(large)
        groups.large_keys.write.parquet(keys)
    return ReviewStore(*names, large, keys, page_findings)


def store_keys(reviews: DataFrame, path: str, buckets: int = BUCKETS) -> str:
    """The keys of reviews by job id, which is all that incoming findings need; the name of their table."""
    name = f"review_keys_{uuid.uuid4().hex}"
    write_buckets(reviews.select("job_id", F.col("id").alias("review_id")), name, path, "job_id", buckets)
    return name


def stored_detail(spark: SparkSession, store: ReviewStore, ordinal: tuple[str, ...] = ORDINAL) -> DataFrame:
    """``review_detail`` of a store: no row of its buckets is shuffled."""
    heads, findings = spark.table(store.reviews), spark.table(store.findings)
    if store.large is None:
        return review_detail(heads, findings, ordinal, store.page_findings, placed=True)
    keys = checked_broadcast(spark.read.parquet(store.large_keys)).withColumnRenamed("review_id", "id")
    small = review_detail(attach_by_key(heads, keys, ["id"], "left_anti"), findings, ordinal, store.page_findings, placed=True)
    theirs = attach_by_key(heads, keys, ["id"], "left_semi")
    return small.unionByName(review_detail(theirs, spark.read.parquet(store.large), ordinal, store.page_findings))


def store_incoming(findings: DataFrame, path: str, buckets: int = BUCKETS) -> str:
    """Findings that carry a job id, bucketed by it; the name of their table."""
    name = f"incoming_{uuid.uuid4().hex}"
    write_buckets(findings, name, path, "job_id", buckets)
    return name


def stored_attach(spark: SparkSession, incoming: str, store: ReviewStore | str) -> DataFrame:
    """Incoming findings with the id of their review in place of the job id (J2), bucket by bucket, from a store or the
    name of its keys alone."""
    keys = store if isinstance(store, str) else store.keys
    return spark.table(incoming).join(spark.table(keys), "job_id").drop("job_id")


def stored_cascade(spark: SparkSession, store: ReviewStore, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of a store's reviews and findings without the given jobs (J4). Only the keys of doomed reviews
    move."""
    doomed = spark.table(store.keys).join(jobs.select("job_id").distinct(), "job_id", "left_semi").select("review_id")
    heads, findings = spark.table(store.reviews), spark.table(store.findings)
    left = heads.join(doomed.withColumnRenamed("review_id", "id"), "id", "left_anti")
    rest = findings.join(doomed, "review_id", "left_anti")
    if store.large is not None:
        rest = rest.unionByName(spark.read.parquet(store.large).join(doomed, "review_id", "left_anti"))
    return left, rest


def drop_store(spark: SparkSession, store: ReviewStore) -> None:
    """Forget the tables of a store; their files stay."""
    for name in filter(None, (store.reviews, store.findings, store.keys)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")

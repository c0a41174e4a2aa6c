"""Topics: requests and static results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diffmill.fixed import REQUEST_TOPIC, STATIC_TOPIC
from diffmill.schemas import MESSAGE


def read_messages(
    spark: SparkSession, topic: str, starting: str, servers: str | None = None, path: str | None = None, **options: str
) -> DataFrame:
    """Stream of messages: key and value as text, partition, offset, timestamp.

    From a broker with ``servers``, or from a folder of landed messages with ``path``.
    """
    if (servers is None) == (path is None):
        raise ValueError("give either servers or path")
    if path is not None:
        return spark.readStream.schema(MESSAGE).options(**options).parquet(path)
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**options)
        .load()
    )
    return stream.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", "timestamp"
    )


def read_requests(spark: SparkSession, **where: str) -> DataFrame:
    """Review requests, new ones only."""
    return read_messages(spark, REQUEST_TOPIC, "latest", **where)


def read_static_results(spark: SparkSession, **where: str) -> DataFrame:
    """Static results from the beginning."""
    return read_messages(spark, STATIC_TOPIC, "earliest", **where)


def to_topic(df: DataFrame, key_col: str = "job_id") -> DataFrame:
    """Rows as messages: keyed by job, the whole row as JSON (S3)."""
    return df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(messages: DataFrame, topic: str, servers: str) -> None:
    """Send a batch of messages to a broker (S3)."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_stream(messages: DataFrame, topic: str, servers: str, checkpoint: str) -> StreamingQuery:
    """Send a stream of messages to a broker (S3). The checkpoint makes it resume where
    it stopped; a message may be sent again, which the job id as key tells apart."""
    writer = messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return writer.option("topic", topic).option("checkpointLocation", checkpoint).start()

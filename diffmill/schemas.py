"""Record shapes shared by batch and streaming operators."""

from __future__ import annotations

from pyspark.sql import types as T

DELIVERY = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("raw_body", T.StringType()),
])

REQUEST = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("pr_number", T.IntegerType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("diff", T.StringType()),
])

STATIC_RESULT = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("static_metrics", T.VariantType()),
])

FILE_METRIC = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("issues", T.LongType()),
    T.StructField("cyclomatic_complexity", T.IntegerType()),
    T.StructField("line_count", T.IntegerType()),
    T.StructField("errors", T.LongType()),
    T.StructField("warnings", T.LongType()),
])

FINDING = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("suggestion", T.StringType()),
])

REVIEWS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("job_id", T.StringType(), False),
    T.StructField("repo", T.StringType(), False),
    T.StructField("pr_number", T.IntegerType(), False),
    T.StructField("commit_sha", T.StringType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("quality_score", T.IntegerType()),
    T.StructField("static_metrics", T.StringType()),
    T.StructField("github_comment_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
])

FINDINGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("review_id", T.LongType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("message", T.StringType(), False),
    T.StructField("suggestion", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

# A topic message as the Kafka source delivers it, also landed in files for replay.
MESSAGE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

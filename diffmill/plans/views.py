"""Views that map the given tables to deliveries, files, responses, reviews and findings.

The expressions are plain SQL that Spark and the checking engine both read, so that
each is written once. ``{}``-style differences between the two are named explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.functions.signature import hmac_sha256

SECRET = "default-secret"
ORDINAL = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")

REVIEWS = {
    "id": "o_orderkey",
    "job_id": "md5(cast(o_orderkey as varchar(20)))",
    "repo": "concat('org/repo', cast(o_custkey % 50 as varchar(20)))",
    "pr_number": "o_custkey",
    "commit_sha": "md5(concat('c', cast(o_orderkey as varchar(20))))",
    "status": "case when o_orderstatus='P' then 'pending' when o_orderstatus='O' then 'running' "
    "when o_orderkey % 7 = 0 then 'failed' else 'done' end",
    "quality_score": "case when o_orderstatus='F' and o_orderkey % 7 <> 0 "
    "then cast(floor(o_totalprice) as bigint) % 101 end",
    "static_metrics": "case o_orderkey % 5 when 0 then null when 1 then '{bad' when 2 then '{\"uml_s3_url\": \"\"}' "
    "else concat('{\"uml_s3_url\": \"s3://b/uml/', cast(o_orderkey as varchar(20)), '.puml\"}') end",
    "github_comment_id": "case when o_orderkey % 11 = 0 then cast(o_orderkey as varchar(20)) end",
    "created_at": "o_orderdate",
}

FINDINGS = {
    "review_id": "l_orderkey",
    "type": "case l_partkey % 9 when 0 then 'security_issue' when 1 then 'Security' when 2 then 'BUG' "
    "when 3 then 'best_practice' when 4 then 'Design Pattern' when 5 then 'code_smell' when 6 then 'weird' "
    "when 7 then 'Vulnerability' else 'suggestion' end",
    "severity": "case l_suppkey % 6 when 0 then 'CRITICAL' when 1 then 'High' when 2 then 'medium' "
    "when 3 then 'low' when 4 then 'blocker' else '' end",
    "file_path": "case when l_linenumber % 5 = 0 then '' else concat('src/f', cast(l_partkey as varchar(20)), '.ts') end",
    "line_number": "case when l_quantity > 45 then 0 else cast(l_quantity as int) end",
    "message": "concat('m', cast(l_suppkey as varchar(20)), '-', cast(l_linenumber as varchar(20)))",
    "suggestion": "case when l_partkey % 4 = 0 then '' when l_partkey % 4 = 1 then null "
    "else concat('fix ', cast(l_partkey as varchar(20))) end",
    "created_at": "l_shipdate",
}

# A change of score, or of none, to every other job three times.
SCORE_CHANGES = {
    "job_id": "md5(cast(cast(floor(event_id / 3) as bigint) * 2 as varchar(20)))",
    "quality_score": "case when event_id % 7 <> 0 then event_id % 101 end",
}

# With the columns that only a full record shows.
REVIEW_RECORD = REVIEWS | {
    "completed_at": "case when o_orderstatus='F' and o_orderkey % 7 <> 0 then o_orderdate + interval '1' day end",
}
FINDING_RECORD = FINDINGS | {"id": "l_orderkey * 10 + l_linenumber"}

DELIVERIES = {
    "event_id": "event_id",
    "event": "case when event_type='signup' then 'push' else 'pull_request' end",
    "raw_body": "concat('{\"repository\": {\"full_name\": ', case when event_id % 13 = 0 then 'null' "
    "else concat('\"org/repo', cast(user_id as varchar(20)), '\"') end, '}, \"pull_request\": {\"number\": ', "
    "cast(event_id % 50 as varchar(20)), ', \"head\": {\"sha\": \"', md5(cast(event_id as varchar(20))), '\"}}', "
    "case when event_id % 3 = 0 then ', \"diff\": \"+x\"' else '' end, '}')",
}

RAW_SCORES = """case event_id % 12
  when 0 then concat('{"quality_score": ', cast(event_id % 140 - 20 as varchar(20)), ', "findings": []}')
  when 1 then '{"quality_score": "85"}'   when 2 then '{"quality_score": 85.7}'
  when 3 then '{"quality_score": "85.7"}' when 4 then '{"quality_score": null}'
  when 5 then '{}'                        when 6 then '{"quality_score": true}'
  when 7 then 'not json'                  when 8 then '{"quality_score": [1]}'
  when 9 then concat('```json ', '{"quality_score": 42}', ' ```')
  when 10 then '{"quality_score": 1e2}'   else '' end"""

RAW_FINDINGS = """case event_id % 10
  when 0 then concat('{"quality_score": ', cast(event_id % 101 as varchar(20)), ', "findings": [{"type": "Security", "severity": "HIGH", "message": "a', cast(event_id as varchar(20)), '", "line_number": ', cast(event_id % 90 as varchar(20)), ', "file_path": "src/a.ts"}, {"type": "weird", "message": "b"}]}')
  when 1 then '{"quality_score": 70, "findings": [{"message": null}]}'
  when 2 then '{"quality_score": 71, "findings": [{"message": "x", "line_number": "twelve"}]}'
  when 3 then '{"quality_score": 72, "findings": {"message": "x"}}'
  when 4 then '{"quality_score": 73, "findings": [{"message": "x", "severity": "blocker", "type": null}]}'
  when 5 then '[1, 2]'
  when 6 then '{"quality_score": 74, "findings": [{"message": "x", "line_number": "12", "suggestion": ""}], "plantuml": "@startuml"}'
  when 7 then '{"quality_score": 75, "findings": ["x"]}'
  when 8 then 'sorry, no json'
  else concat('```json', chr(10), '{"quality_score": 76, "findings": [{"message": "y", "type": "best tip", "severity": "critical"}]}', chr(10), '```') end"""

CODE_STEPS = (
    (", ", " || if ("),
    (". ", " ? while (x) "),
    (" le ", " catch(e) "),
    (" the ", " for (;;) "),
    (" de ", " switch (v) "),
    (" der ", " if("),
)


def code_content(text: str = "text") -> str:
    for old, new in CODE_STEPS:
        text = f"replace({text}, '{old}', '{new}')"
    return text


CODE = {
    "doc_id": "doc_id",
    "repo": "source",
    "file_path": "concat('src/', source, '/f', cast(doc_id as varchar(20)), case doc_id % 8 when 0 then '.js' "
    "when 1 then '.jsx' when 2 then '.ts' when 3 then '.tsx' when 4 then '.java' when 5 then '.py' "
    "when 6 then '.md' else '' end)",
    "content": code_content(),
}

# Repositories that one of two snapshots changes.
TOUCHED = "[0-4]$"

# Paths as a walk over a checked-out tree meets them.
TREE_PATH = (
    "concat(case doc_id % 7 when 0 then 'node_modules/' when 1 then '.git/' when 2 then 'src/.cache/' "
    "when 3 then 'src/node_modules/x/' else 'src/' end, case doc_id % 11 when 0 then '.hidden.js' "
    "when 1 then concat('F', cast(doc_id as varchar(20)), '.TS') when 2 then '.js' "
    "else concat('f', cast(doc_id as varchar(20)), case doc_id % 8 when 0 then '.js' when 1 then '.d.ts' "
    "when 2 then '.py' when 3 then '.md' when 4 then '' when 5 then '.java' when 6 then '.jsx' else '.' end) end)"
)

LINT = {
    "doc_id": "cast(floor(l_partkey * 3 / 5) as bigint)",
    "severity": "case when l_returnflag='A' then 2 else 1 end",
}

STATIC = {
    "offset_no": "event_id",
    "job_id": "md5(cast(cast(floor(floor(event_id / 2) * 16 / 5) as bigint) as varchar(20)))",
    "static_metrics": "case when event_id % 23 = 0 then '{bad' else concat('{\"counts\": {\"issues\": ', "
    "cast(event_id % 9 as varchar(20)), '}, \"uml_s3_url\": ', case when event_id % 5 = 0 then '\"\"' "
    "when event_id % 5 = 1 then 'null' else concat('\"s3://b/uml/', cast(event_id as varchar(20)), '.puml\"') end, "
    "'}') end",
}

# Of three jobs one has results, up to 180 events before or after its review.
RESULT_JOB = "md5(cast(cast(floor(event_id / 3) as bigint) * 3 + (event_id % 7) * 60 - 180 as varchar(20)))"

PR_FILES = {
    "repo": "concat('org/repo', cast(conv_id % 50 as varchar(20)))",
    "pr_number": "conv_id",
    "seq": "turn",
    "filename": "concat('src/m', cast(turn as varchar(20)), '.js')",
    "status": "case role when 'system' then 'removed' when 'assistant' then 'added' else 'modified' end",
    "is_binary": "conv_id % 11 = 3",
    "patch": "case when (conv_id + turn) % 4 <> 0 then text end",
    "content": "text",
    "head_sha": "md5(cast(conv_id as varchar(20)))",
}

# Texts with a marker line, with its words on different lines, and as they are.
MARKED = {
    "doc_id": "doc_id",
    "diff": "case doc_id % 4 when 0 then concat(text, chr(10), 'Binary files a/x and b/x differ') "
    "when 1 then concat('Binary files', chr(10), text, ' differ') else text end",
}

CHECKOUTS = {
    "id": "o_orderkey",
    "head": "concat(case when o_orderkey % 2 = 0 then ' ' else '' end, "
    "md5(cast(o_orderkey as varchar(20))), chr(10))",
    "sha": "case when o_orderkey % 7 = 0 then md5('x') else md5(cast(o_orderkey as varchar(20))) end",
}

LATENCY = {
    "status": "event_type",
    "latency_ms": "cast(value as decimal(12,2)) * 100",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream. The pattern matches one file or one folder of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def view(df: DataFrame, columns: dict[str, str], *more: str) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()], *more)


def reviews(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "orders"), REVIEWS)


def raw_findings(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "lineitem"), FINDINGS, *ORDINAL)


def deliveries(source: DataFrame) -> DataFrame:
    signed = F.concat(F.lit("sha256="), hmac_sha256(F.col("raw_body"), SECRET))
    signature = (
        F.when(F.col("event_id") % 17 == 0, None)
        .when(F.col("event_type") == "error", "sha256=00")
        .when(F.col("event_id") % 19 == 0, "sha256=" + "0" * 64)
        .otherwise(signed)
    )
    return view(source, DELIVERIES, "event_type").withColumn("signature", signature).drop("event_type")


def raw_scores(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "events"), {"event_id": "event_id", "raw": RAW_SCORES})


def raw_responses(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "events"), {"event_id": "event_id", "raw": RAW_FINDINGS})


def code(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "documents"), CODE)


def lint(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "lineitem"), LINT)


def static_results(source: DataFrame) -> DataFrame:
    return view(source, STATIC)


def pr_files(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "conversations"), PR_FILES)


def pr_contents(spark, sf_dir) -> DataFrame:
    return pr_files(spark, sf_dir).select(
        "repo", F.col("head_sha").alias("sha"), F.col("filename").alias("path"), "content"
    )


def prs(spark, sf_dir) -> DataFrame:
    """Pull requests with their original diff: header and text of each file in order."""
    name = F.col("filename")
    section = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"), F.col("content"))
    rows = pr_files(spark, sf_dir).select("repo", "pr_number", F.struct("seq", section.alias("s")).alias("e"))
    texts = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["s"])
    return rows.groupBy("repo", "pr_number").agg(F.array_join(texts, "\n").alias("diff"))


def latency(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "events"), LATENCY)

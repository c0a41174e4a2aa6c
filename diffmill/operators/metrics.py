"""Static metrics of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.functions.text import cyclomatic, is_measured, language_of, line_count
from diffmill.plans.paging import checked_broadcast, number_pages, split_by_size

COUNTS = ("issues", "errors", "warnings")


def changed_files(base: DataFrame, head: DataFrame, keys: tuple[str, ...] = ("repo", "file_path")) -> DataFrame:
    """Added, modified and deleted files between two snapshots.

    Contents are hashed where they are read; only paths and hashes are shuffled.
    """
    old = base.select(*keys, F.md5(F.col("content")).alias("_old"), F.lit(True).alias("_in_base"))
    new = head.select(*keys, F.md5(F.col("content")).alias("_new"), F.lit(True).alias("_in_head"))
    change = (
        F.when(F.col("_in_base").isNull(), "added")
        .when(F.col("_in_head").isNull(), "deleted")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return (
        old.join(new, list(keys), "full_outer")
        .select(*keys, change.alias("change"))
        .where(F.col("change").isNotNull())
    )


def analyzed_files(changes: DataFrame) -> DataFrame:
    """Changed files that still exist at head."""
    return changes.where(F.col("change") != "deleted")


def lint_rollup(files: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """Errors (severity 2), warnings (1) and issues per file; zeros without messages."""
    return files.select(*keys).join(_lint_sums(messages, keys), keys, "left").fillna(0, list(COUNTS))


def _lint_sums(messages: DataFrame, keys: list[str]) -> DataFrame:
    errors = F.sum(F.when(F.col("severity") == 2, 1).otherwise(0))
    warnings = F.sum(F.when(F.col("severity") == 1, 1).otherwise(0))
    return messages.groupBy(*keys).agg(
        (errors + warnings).alias("issues"), errors.alias("errors"), warnings.alias("warnings")
    )


def file_metrics(
    files: DataFrame,
    messages: DataFrame | None = None,
    keys: tuple[str, ...] = ("repo", "file_path"),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Metrics record of every readable file (G5), with the ``carry`` columns.

    Complexity is counted for JavaScript and TypeScript only and is 0 elsewhere; so
    are lint counts. Contents are reduced to numbers before the join with ``messages``.
    """
    keys = list(keys)
    language = language_of(F.col("file_path"))
    measured = files.where(F.col("content").isNotNull()).select(
        *keys,
        *carry,
        language.alias("language"),
        F.when(is_measured(language), cyclomatic(F.col("content"))).otherwise(0).alias("cyclomatic_complexity"),
        line_count(F.col("content")).alias("line_count"),
    )
    none = F.lit(0).cast("bigint")
    if messages is None:
        return measured.withColumns({c: none for c in COUNTS})
    joined = measured.join(_lint_sums(messages, keys), keys, "left")
    linted = is_measured(F.col("language")) & F.col("issues").isNotNull()
    return joined.withColumns({c: F.when(linted, F.col(c)).otherwise(none) for c in COUNTS})


def metrics_counts(metrics: DataFrame, by: list[str] | tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """Issues, errors, warnings and files analyzed, over all or per group (A1).

    No files give zeros; name all ``groups`` to get a row for the empty ones too.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
    counts = metrics.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("files_analyzed"))
    if groups is None:
        return counts
    return groups.select(*by).join(counts, list(by), "left").fillna(0, [*COUNTS, "files_analyzed"])


def metrics_document(
    metrics: DataFrame, by: list[str], page_files: int = 50_000, sized_by: DataFrame | None = None
) -> DataFrame:
    """One metrics document per group: files by path, and the group's counts (A2).

    A group of more than ``page_files`` files comes in pages in path order; every
    page carries the counts of the whole group. ``sized_by`` may name the list of all
    files, which is cheaper to count than their metrics.
    """
    fields = ["file_path", "language", "issues", "cyclomatic_complexity", "line_count", "errors", "warnings"]
    rows, order = metrics.select(*by, *fields), [F.col("file_path")]
    groups = split_by_size(rows, by, page_files, sized_by)
    whole = _documents(groups.small.withColumn("page", F.lit(0).cast("bigint")).repartition(*by), by, fields)
    if groups.large is None:
        return whole
    numbered = number_pages(groups.large, by, order, page_files).repartition(*by, "page")
    pages = _documents(numbered, by, fields).drop("counts")
    totals = metrics_counts(groups.large, by)
    counted = totals.select(*by, F.struct(*_NUMBERS).alias("counts"))
    return whole.unionByName(pages.join(checked_broadcast(counted), by, "inner"))


_NUMBERS = [*COUNTS, "files_analyzed"]


def _documents(paged_rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in COUNTS]
    return (
        paged_rows.groupBy(*by, "page")
        .agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias("file_metrics"),
            *sums,
            F.count(F.lit(1)).alias("files_analyzed"),
        )
        .select(*by, "page", "file_metrics", F.struct(*_NUMBERS).alias("counts"))
    )


def metrics_message(documents: DataFrame, job: str) -> DataFrame:
    """Result messages of finished documents: ``job_id`` and ``static_metrics`` as JSON."""
    return documents.select(
        F.col(job).alias("job_id"), "page", F.to_json(F.struct("file_metrics", "counts")).alias("static_metrics")
    )

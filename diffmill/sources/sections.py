"""Landed diffs of any size, read section by section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffmill.functions.text import header_path
from diffmill.session import stored

_HEADER = "diff --git"
_PLACE = ["file", "_block"]


def read_sections(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``file``, ``segment``, ``path`` and ``text`` of each section of the diff files below ``path``.

    The rows are those of ``split_diff`` with one diff per file, but only a section has to fit a
    cell, not a diff: files are read in splits of ``spark.sql.files.maxPartitionBytes``, and records end before a
    line that starts a section. A section belongs to the split it starts in. Sections are numbered by
    the counts of the splits before. Those are one row per split, counted when the plan is built and written down; Spark
    broadcasts them if they are under its threshold, and then no text is shuffled. If files or the size of splits
    change before the rows are read, the read fails instead of numbering them wrongly.

    Folders named ``key=value`` add their columns. An empty file has no sections, and a last line that is the bare
    start of a header is left out. Compressed files are read whole by one task.
    """
    lines = spark.read.option("lineSep", "\n" + _HEADER).option("pathGlobFilter", pattern).text(path)
    keys = [c for c in lines.columns if c != "value"]
    # ids ascend by one within a split, as nothing is filtered before
    rows = lines.select(
        *keys, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    blocks = rows.groupBy(*_PLACE).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # whether the first record of a file is a section itself: only first splits can tell
    heads = rows.where("_block = 0").groupBy("file").agg(F.min_by(F.col("value").startswith(_HEADER), "_id").alias("_opens"))
    blocks = stored(blocks.join(heads, "file", "left"), "diff-splits").withColumnsRenamed({"file": "_file", "_block": "_start"})
    same = F.col("_id").between(F.col("_first"), F.col("_first") + F.col("_n") - 1)
    at = F.when(same, F.col("_before") + F.col("_id") - F.col("_first")).otherwise(F.raise_error(F.lit("splits changed since they were counted")))
    placed = rows.join(blocks, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_start")), "left").withColumn("_at", at)
    text = F.when(F.col("_at") > 0, F.concat(F.lit(_HEADER), "value")).otherwise(F.col("value"))
    segment = F.col("_at") + F.when(F.col("_opens"), 1).otherwise(0)
    named = F.when(F.col("segment") > 0, header_path(F.substring_index("text", "\n", 1)))
    return placed.select(*keys, "file", segment.cast("int").alias("segment"), text.alias("text")).select(*keys, "file", "segment", named.alias("path"), "text")

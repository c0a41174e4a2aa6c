"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Targets: sources in code point order, null last, weigh 5, 2, 1 in turn and share one and a half times
all words; no target exceeds twice its source, and the excess is shared again by weight. The level at
which the shares stop is found in closed form from sums over the sources in order of their cap.

Sampling: a document's key is an exponential variate divided by its quality weight, so that taking
documents by ascending key draws without replacement in proportion to the weights. Complete epochs
take every document; what is left of a target is filled by the documents of the smallest keys, the
last one included if that comes nearer to the target.

No source is ever sorted whole. Keys fall into buckets of equal width on a logarithmic scale, sqrt(rows) for each
factor of e; bucket sums are combined in each task, their running sum finds the one bucket in which a source's
budget ends, and only that bucket is sorted. The logarithm of an exponential variate has no density above 1 / e, and
dividing by weights, of whatever distribution, only averages shifted copies of it: a bucket is expected to hold no
more than a source's rows / (e sqrt(rows)). The result is one threshold per source, so every document is decided
by a comparison, without moving its row.

Defined results: a null or empty text has size 0 and is taken 0; a null source is a source of its
own; a source without words has target 0; rows equal in id and text are decided alike; an empty table
gives an empty result. The variate comes from a hash of the id, so reruns agree; equal keys are taken by the hash of the
text, then by size. Rows that share one id share a variate, so they meet in a bucket. A text of any length is
counted whole. Columns of the input may have any names; they travel inside ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill.session import stored

WEIGHTS = (5, 2, 1)
#: Words to take as a share of all words, and the most a target may be of its source.
SHARE, CAP = 1.5, 2


def size_of(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def variate(id_col: Column) -> Column:
    """A number between 0 and 1 that follows from the id."""
    digits = F.md5(F.concat(F.lit("mix-"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digits, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def sampling_key(id_col: Column, text: Column, size: Column) -> Column:
    """Exponential variate over the quality weight 1 / (1 + 20 symbols per word)."""
    symbols = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0))
    return -F.log(variate(id_col)) * (1 + 20.0 * symbols / F.greatest(size, F.lit(1)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size and target. ``sizes`` holds one row per source, so these windows
    see as many rows as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    sized = sizes.withColumns({
        "_weight": F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")),
        "_cap": F.col("source_size") * cap,
        "_total": F.sum("source_size").over(Window.partitionBy()) * share,
    })
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(after)
    levels = sized.withColumn("_level", level)
    stops = F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.col("_level"))
    share_of = F.max(stops).over(Window.partitionBy()) * F.col("_weight")
    return levels.select("source", "source_size", F.least(F.col("_cap").cast("double"), share_of).alias("target"))


def _order() -> Column:
    """What documents of a source are taken by."""
    return F.struct("key", "tie", "size")


def _bucket(buckets: int) -> Column:
    return F.floor(buckets * F.log("key"))


def thresholds(rows: DataFrame, buckets: int) -> DataFrame:
    """For each source: source_size, target, epochs, and where the rest of its target ends:
    ``edge``, the bucket, and ``last``, the last document taken in that bucket.

    ``rows`` holds source, size, key and tie of every document.
    """
    rows = rows.withColumn("bucket", _bucket(buckets))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    goals = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    goals = goals.withColumn("epochs", epochs).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    goals = stored(goals, "mix-goals")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = sums.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    g = goals.select(F.col("source").alias("_source"), "rest")
    edges = summed.join(g, F.col("source").eqNullSafe(F.col("_source")))
    edges = edges.where("before < rest and rest <= before + size").select("_source", F.col("bucket").alias("edge"), "before", "rest")
    edges = stored(edges, "mix-edges")
    near = rows.join(edges, rows["source"].eqNullSafe(edges["_source"]) & (rows["bucket"] == edges["edge"]))
    within = Window.partitionBy("source").orderBy(_order()).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = near.where(F.col("ahead") + F.col("size") / 2 <= F.col("rest")).groupBy("source")
    last = last.agg(F.max(_order()).alias("last")).withColumnRenamed("source", "_last_source")
    found = goals.join(edges.select("_source", "edge"), goals["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
    found = found.join(last, found["source"].eqNullSafe(F.col("_last_source")), "left").drop("_last_source", "rest")
    return stored(found, "mix-thresholds")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row`` (all columns of ``docs``), size, source_size, target, and ``copies``, the times the
    mix takes the document whole."""
    size = size_of(docs[text_col])
    thin = docs.select(
        docs[source_col].alias("source"), size.alias("size"), docs[id_col].alias("_id"),
        F.xxhash64(docs[text_col]).alias("tie"), docs[text_col].alias("_text"),
    ).select("source", "size", "tie", sampling_key(F.col("_id"), F.col("_text"), F.col("size")).alias("key"))
    rows = stored(thin, "mix-keys")
    buckets = max(1, math.isqrt(rows.count()))  # for each factor of e
    goals = thresholds(rows, buckets).withColumnRenamed("source", "_goal_source")
    whole = docs.select(F.struct("*").alias("row"), docs[source_col].alias("source"), docs[text_col].alias("_text"), docs[id_col].alias("_id"))
    whole = whole.withColumn("size", size_of(F.col("_text"))).withColumn("tie", F.xxhash64("_text"))
    whole = whole.withColumn("key", sampling_key(F.col("_id"), F.col("_text"), F.col("size")))
    joined = whole.join(goals, whole["source"].eqNullSafe(F.col("_goal_source")), "left")
    bucket = _bucket(buckets)
    taken = (bucket < F.col("edge")) | ((bucket == F.col("edge")) & (_order() <= F.col("last")))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("bigint"))
    return joined.select("row", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mixed_rows(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    mixed = mix_sources(docs, **columns).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

"""Changed files between stored snapshots by digests of their folders.

Each folder has a digest of all that lies below it: every file adds the hash of its path and content to all
folders above it, in one aggregation that is combined before its shuffle. The sum does not depend on
the order of files, so no folder is gathered. Two snapshots are compared from the top: only folders whose
digests differ are entered, level by level, and their children are found by a pushed filter on the
key of their parent, by which the files of a level are sorted.

A digest has 256 bits, from four independent hashes that are combined by exclusive or. That tells any
accidental change; it is no proof against contents that were made to collide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.plans.paging import checked_broadcast
from diffmill.session import stored

LANES = 4
#: Most folders whose keys are named in a pushed filter; more are met by a join alone.
PUSHED_FOLDERS = 5_000
_NODE = ["repo", "path", "is_file"]
_STORED = "repo string, path string, is_file boolean, parent string, digest string, parent_key long, level int"


@dataclass(frozen=True)
class Comparison:
    """``changes`` are the rows of ``changed_files``; ``entered`` counts the children that were compared."""

    changes: DataFrame
    entered: int


def _folder_key() -> Column:
    return F.xxhash64("repo", "parent")


def tree_nodes(files: DataFrame) -> DataFrame:
    """Files and folders of a snapshot (repo, file_path, content) with digest, parent and level. The root of
    a repo is the empty path on level 0."""
    lanes = [F.xxhash64(F.lit(k), "file_path", F.sha2(F.col("content").cast("binary"), 256)).alias(f"d{k}") for k in range(LANES)]
    names = F.split("file_path", "/")
    # the file itself, and the folders above it: "", "a", "a/b" of "a/b/c.js"
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.struct(
        n.alias("level"), F.array_join(F.slice(names, 1, n), "/").alias("path"), F.lit(False).alias("is_file")
    ))
    itself = F.array(F.struct(F.size(names).alias("level"), F.col("file_path").alias("path"), F.lit(True).alias("is_file")))
    nodes = files.select("repo", *lanes, F.inline(F.concat(above, itself)))
    sums = [F.bit_xor(f"d{k}").alias(f"d{k}") for k in range(LANES)]
    parent = F.when(F.col("level") == 0, None).when(F.col("level") == 1, "").otherwise(
        F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    )
    return (
        nodes.groupBy("level", *_NODE)
        .agg(*sums, F.count(F.lit(1)).alias("files"))
        .withColumn("digest", F.concat_ws("-", *[F.hex(f"d{k}") for k in range(LANES)], "files"))
        .select("level", *_NODE, parent.alias("parent"), "digest")
        .withColumn("parent_key", _folder_key())
    )


def write_tree(files: DataFrame, path: str) -> None:
    """Store the nodes of a snapshot by level, sorted by the key of their parent."""
    order = ["level", "parent_key", "path"]  # by path too, so that a large folder is spread
    placed = tree_nodes(files).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.partitionBy("level").option("parquet.block.size", 16 << 20).parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


def compare_trees(spark: SparkSession, base: str, head: str) -> Comparison:
    """Files added, modified and deleted between two stored snapshots. Rounds end with the deepest
    differing folder."""
    trees = [read_tree(spark, p) for p in (base, head)]
    folders, changes, entered, level = None, None, 0, 0
    while True:
        old, new = (_children(t, level, folders) for t in trees)
        differing = stored(_differing(old, new), "differing")
        counts = differing.agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("is_file"), 1)).alias("folders"), F.sum("seen").alias("seen")
        ).first()
        entered += counts.seen or 0
        found = differing.where("is_file and change is not null").select("repo", F.col("path").alias("file_path"), "change")
        changes = found if changes is None else changes.unionByName(found)
        if not counts.folders:
            return Comparison(changes, entered)
        folders = differing.where("not is_file and change is not null").select("repo", F.col("path").alias("parent"))
        level += 1


def _children(tree: DataFrame, level: int, folders: DataFrame | None) -> DataFrame:
    nodes = tree.where(F.col("level") == level)
    if folders is None:
        return nodes
    few = folders.select(_folder_key().alias("key")).limit(PUSHED_FOLDERS + 1)
    keys = few.agg(F.collect_list("key").alias("keys")).first().keys
    if len(keys) <= PUSHED_FOLDERS:
        nodes = nodes.where(F.col("parent_key").isin(keys))
    same = [nodes[c].eqNullSafe(folders[c]) for c in ("repo", "parent")]
    return nodes.join(checked_broadcast(folders), same, "left_semi")


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of either side that differ, and one row with the number of nodes that were looked at."""
    a = old.select(*_NODE, F.col("digest").alias("_old"))
    b = new.select(*[F.col(c).alias(f"_{c}") for c in _NODE], F.col("digest").alias("_new"))
    met = a.join(b, [a[c].eqNullSafe(b[f"_{c}"]) for c in _NODE], "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old") != F.col("_new"), "modified")
    )
    one = F.lit(1)
    looked = met.select(*[F.coalesce(c, f"_{c}").alias(c) for c in _NODE], change.alias("change"), one.alias("seen"))
    same = looked.where("change is null").groupBy().agg(F.sum("seen").alias("seen"))
    nobody = same.select(
        F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("is_file"),
        F.lit(None).cast("string").alias("change"), F.coalesce("seen", F.lit(0)).alias("seen"),
    )
    return looked.where("change is not null").withColumn("seen", one.cast("long")).unionByName(nobody)

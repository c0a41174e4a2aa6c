"""Source trees: checkouts on a shared file system, landed as rows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.functions.text import is_code_path
from diffmill.session import stored

#: Entries, or bytes of content, that a task hands on at once.
_ENTRIES, _BYTES = 10_000, 16 << 20
_LISTED = pa.struct([("at", pa.int64()), ("name", pa.string()), ("kind", pa.string())])


def code_files(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Code files only, outside hidden and dependency directories."""
    return df.where(is_code_path(F.col(path)))


@dataclass(frozen=True)
class Listing:
    """``files`` and ``unreadable`` folders of checkouts: their columns and ``file_path``, relative to the root."""

    files: DataFrame
    unreadable: DataFrame


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder: the folder's columns, and name and kind of the entry."""

    def sent(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        rows = pa.array(found, _LISTED)
        carried = batch.take(rows.field("at"))
        return pa.RecordBatch.from_arrays([*carried.columns, rows.field("name"), rows.field("kind")], [*carried.schema.names, "name", "kind"])

    for batch in batches:
        found: list[dict] = []
        for at, (root, folder) in enumerate(zip(batch.column("_root").to_pylist(), batch.column("_folder").to_pylist())):
            try:
                with os.scandir(os.path.join(root, folder)) as entries:
                    for entry in entries:
                        kind = "folder" if entry.is_dir(follow_symlinks=False) else "file"
                        if kind == "folder" and (entry.name.startswith(".") or entry.name == "node_modules"):
                            continue
                        found.append({"at": at, "name": entry.name, "kind": kind})
                        if len(found) >= _ENTRIES:
                            yield sent(batch, found)
                            found = []
            except OSError as e:
                found.append({"at": at, "name": type(e).__name__, "kind": "unreadable"})
        yield sent(batch, found)


def list_files(checkouts: DataFrame, root: str = "root") -> Listing:
    """List the trees of all checkouts (S7), a level of folders per round.

    The folders of a level are dealt out over all tasks, whichever tree they belong to, so one large
    tree is listed by many tasks. Hidden and dependency folders are not entered, nor links to folders.
    A folder that cannot be read is skipped and listed. Rounds end with the deepest folder.
    """
    spark = checkouts.sparkSession
    carried = [c for c in checkouts.columns if c != root]
    columns = [*carried, "_root"]
    level = checkouts.select(*carried, F.col(root).alias("_root"), F.lit("").alias("_folder"))
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in level.schema.fields), "name string, kind string"])
    below = F.when(F.col("_folder") == "", F.col("name")).otherwise(F.concat_ws("/", "_folder", "name"))
    levels = []
    while True:
        spread = level.repartition(spark.sparkContext.defaultParallelism)
        listed = stored(spread.mapInArrow(_entries, shape), "listed")
        levels.append(listed)
        level = listed.where("kind = 'folder'").select(*columns, below.alias("_folder"))
        if level.isEmpty():
            break
    everything = reduce(DataFrame.unionByName, levels)
    root_named = [*carried, F.col("_root").alias(root)]
    return Listing(
        everything.where("kind = 'file'").select(*root_named, below.alias("file_path")),
        everything.where("kind = 'unreadable'").select(*root_named, F.col("_folder").alias("file_path"), F.col("name").alias("error")),
    )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, contents, held = 0, [], 0
        paths = zip(batch.column("_root").to_pylist(), batch.column("file_path").to_pylist())
        for at, (root, path) in enumerate(paths, 1):
            try:
                with open(os.path.join(root, path), "rb") as f:
                    contents.append(f.read())
            except OSError:
                contents.append(None)
            held += len(contents[-1] or b"")
            if held >= _BYTES or at == batch.num_rows:
                part = batch.slice(first, at - first)
                yield part.append_column("content", pa.array(contents, pa.binary()))
                first, contents, held = at, [], 0


def read_files(files: DataFrame, root: str = "root") -> DataFrame:
    """Add ``content`` as bytes to listed files, NULL where a file cannot be read. Files are dealt out over all
    tasks, which send on some megabytes at a time."""
    renamed = files.withColumnRenamed(root, "_root").repartition(files.sparkSession.sparkContext.defaultParallelism)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema.fields), "content binary"])
    return renamed.mapInArrow(_contents, shape).withColumnRenamed("_root", root)


def checkout_files(checkouts: DataFrame, root: str = "root") -> DataFrame:
    """The readable files of each checkout (S7): the other columns, ``file_path`` and ``content`` as bytes."""
    return read_files(list_files(checkouts, root).files, root).where("content is not null").drop(root)


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``content`` as text; bytes that are no UTF-8 become replacement characters."""
    return files.withColumn(content, F.make_valid_utf8(F.col(content).cast("string")))


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Relative path and content of every readable code file under ``root`` (S7). Only code files are opened."""
    listed = list_files(spark.createDataFrame([(root,)], "root string"))
    return decoded(read_files(code_files(listed.files)).where("content is not null").drop("root"))

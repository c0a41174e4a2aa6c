"""Unified diffs: split, measure and rebuild."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.fixed import EMPTY_BLOB, NEW_FILE_MODE
from diffmill.functions.text import added_lines, diff_paths, has_binary_marker, header_path, short_sha, utf16_length
from diffmill.plans.paging import attach_by_key, number_pages, split_by_size

PR = ["repo", "pr_number"]
DIFF_MARK = "diff --git"
#: About so many names of a pull request share an automaton.
SLICE_NAMES = 20_000


def reviewable_files(files: DataFrame) -> DataFrame:
    """Changed files that are neither removed nor binary."""
    return files.where(
        ~F.col("status").eqNullSafe(F.lit("removed")) & ~F.coalesce(F.col("is_binary"), F.lit(False))
    )


def split_diff(df: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """One row per file section of a diff (R2): ``segment``, ``path``, ``text``.

    The text is cut in place, before every line that starts with ``diff --git``, so
    no line is exploded and nothing is shuffled. Segment 0 holds what comes before
    the first header. Joining the segments with newlines gives the diff back.
    """
    pieces = F.split(F.col(diff), "\n(?=diff --git)", -1)
    starts = F.col(diff).startswith("diff --git").cast("int")
    header = F.substring_index("text", "\n", 1)
    return (
        df.select(*keys, starts.alias("_shift"), F.posexplode(pieces).alias("_pos", "text"))
        .withColumn("segment", F.col("_pos") + F.col("_shift"))
        .withColumn("path", F.when(F.col("segment") > 0, header_path(header)))
        .select(*keys, "segment", "path", "text")
    )


def diff_stats(df: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """Length in UTF-16 units, added lines and files of each diff."""
    text = F.col(diff)
    return df.select(
        *keys,
        utf16_length(text).alias("diff_length"),
        added_lines(text).alias("added_lines"),
        F.size(diff_paths(text)).cast("bigint").alias("files"),
    )


def with_contents(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Content of the added or renamed files that lack a patch.

    ``contents`` is keyed by (repo, sha, path) and only met by the files in need.
    """
    needs = F.col("status").isin("added", "renamed") & (F.coalesce(F.col("patch"), F.lit("")) == "")
    found = contents.select(
        F.col("repo").alias("_repo"), F.col("sha").alias("_sha"), F.col("path").alias("_path"), "content"
    )
    same = (
        (F.col("repo") == F.col("_repo"))
        & (F.col("head_sha") == F.col("_sha"))
        & (F.col("filename") == F.col("_path"))
    )
    return files.where(needs).join(found, same, "left").drop("_repo", "_sha", "_path")


def _opening():
    name = F.col("filename")
    return F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name)


def diff_parts(
    prs: DataFrame, files: DataFrame, contents: DataFrame, match: str = "exact", slice_names: int = SLICE_NAMES
) -> DataFrame:
    """Rebuilt section of every reviewable file (R3, U1): keys, ``seq``, ``part``.

    A patch is used as it is; an added or renamed file without one is written out in
    full; a modified file without one takes its section of the original diff. Each
    file goes through one of the three branches only.

    ``match='exact'`` finds that section by its path, on both sides spread by (pull
    request, path). ``match='contains'`` also accepts a longer path that contains the
    name, and sections that follow directly and match too; the header lines of a diff
    meet every such file, so use it only where names of that kind matter.
    """
    if match not in ("exact", "contains"):
        raise ValueError("match is 'exact' or 'contains'")
    keep = reviewable_files(files).select(*PR, "seq", "filename", "status", "patch", "head_sha")
    has_patch = F.coalesce(F.col("patch"), F.lit("")) != ""
    added = F.when(F.col("status") == "added", F.lit(NEW_FILE_MODE))
    patched = keep.where(has_patch).select(
        *PR, "seq", F.concat_ws("\n", _opening(), added, F.col("patch")).alias("part")
    )
    index = F.concat(F.lit(f"index {EMPTY_BLOB}.."), short_sha(F.col("head_sha"), 7))
    body = F.replace(F.col("content"), F.lit("\n"), F.lit("\n+"))
    written = with_contents(keep, contents).where(F.col("content").isNotNull()).select(
        *PR,
        "seq",
        F.concat_ws(
            "\n",
            _opening(),
            F.lit(NEW_FILE_MODE),
            index,
            F.lit("--- /dev/null"),
            F.concat(F.lit("+++ b/"), F.col("filename")),
            F.concat(F.lit("+"), body),
        ).alias("part"),
    )
    unpatched = keep.where(~has_patch & (F.col("status") == "modified"))
    found = _sections_by_path(unpatched, prs) if match == "exact" else _sections_by_name(unpatched, prs, slice_names)
    return patched.unionByName(written).unionByName(found)


def _sections_by_path(files: DataFrame, prs: DataFrame) -> DataFrame:
    sections = split_diff(prs, PR).where(F.col("segment") > 0).withColumnRenamed("path", "filename")
    return (
        files.select(*PR, "filename", "seq")
        .join(sections, [*PR, "filename"], "inner")
        .groupBy(*PR, "filename", "seq")
        .agg(F.min_by("text", "segment").alias("part"))
        .drop("filename")
    )


def name_runs(names: list[str], heads: list[str]) -> list[dict[str, int]]:
    """For each name that a header line holds: its number in ``names`` and the first run of sections.

    ``heads`` are the first lines of the pieces of a diff. A name's run begins with the
    first header that holds it and goes on until a line that begins like a header and
    does not. One automaton of all names reads every header once; a run is kept as its
    first piece and the number of headers up to its end, so a header costs the names
    that it holds and nothing for the others.
    """
    places: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        places.setdefault(name, []).append(k)
    automaton = ahocorasick.Automaton()
    for name in places:
        if name:
            automaton.add_word(name, name)
    automaton.make_automaton()
    everywhere = {""} if "" in places else set()
    runs: dict[str, list[int]] = {}
    headers: list[int] = []
    for piece, head in enumerate(heads, 1):
        if DIFF_MARK not in head:
            continue
        opens = head.startswith(DIFF_MARK)
        if opens:
            headers.append(piece)
        seen = len(headers)
        held = {name for _, name in automaton.iter(head)} if len(automaton) else set()
        for name in held | everywhere:
            run = runs.get(name)
            if run is None:
                runs[name] = [piece, seen]
            elif opens and run[1] == seen - 1:
                run[1] = seen
    headers.append(len(heads) + 1)
    return [
        {"name": k, "first": first, "last": headers[seen] - 1} for name, (first, seen) in runs.items() for k in places[name]
    ]


_RUNS = "array<struct<name: int, first: int, last: int>>"


def _runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("name", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
    for names, heads in batches:
        pairs = zip(names.to_pylist(), heads.to_pylist())
        yield pa.array([name_runs(n or [], h or []) for n, h in pairs], kind)


def _sliced_names(files: DataFrame, slice_names: int) -> DataFrame:
    """Names of each pull request in lists of about ``slice_names``: a large one has several."""
    named = files.where(F.col("filename").isNotNull()).select(*PR, "seq", "filename")
    slices = F.ceil(F.count(F.lit(1)) / slice_names).alias("_slices")
    large = named.groupBy(*PR).agg(slices).where(F.col("_slices") > 1)
    spread = F.pmod(F.xxhash64("filename", "seq"), F.coalesce("_slices", F.lit(1))).alias("_slice")
    sliced = named.join(large, PR, "left").select(*PR, "seq", "filename", spread)
    return sliced.groupBy(*PR, "_slice").agg(F.collect_list(F.struct("seq", "filename")).alias("_files"))


def _sections_by_name(files: DataFrame, prs: DataFrame, slice_names: int) -> DataFrame:
    """The first run of sections whose header line holds the file's name. The header lines of a
    diff are read once by the automaton of each slice of names; texts are fetched by section
    afterwards."""
    cut = prs.select(*PR, F.split("diff", f"\n(?=[^\n]*{DIFF_MARK})", -1).alias("_pieces"))
    heads = cut.select(*PR, F.transform("_pieces", lambda p: F.substring_index(p, "\n", 1)).alias("_heads"))
    found = F.arrow_udf(_runs, _RUNS)(F.col("_files.filename"), F.col("_heads"))
    wanted = (
        _sliced_names(files, slice_names)
        .join(heads, PR, "inner")
        .select(*PR, "_files", F.explode(found).alias("_run"))
        .select(
            *PR, F.col("_files")[F.col("_run.name")]["seq"].alias("seq"),
            F.explode(F.sequence(F.col("_run.first").cast("bigint"), F.col("_run.last").cast("bigint"))).alias("_piece"),
        )
    )
    pieces = cut.select(*PR, F.posexplode("_pieces").alias("_pos", "text")).select(
        *PR, (F.col("_pos") + 1).cast("bigint").alias("_piece"), "text"
    )
    run = F.sort_array(F.collect_list(F.struct("_piece", "text")))
    return (
        wanted.join(pieces, [*PR, "_piece"], "inner")
        .groupBy(*PR, "seq")
        .agg(F.array_join(F.transform(run, lambda p: p["text"]), "\n").alias("part"))
    )


def rebuild_diff(
    prs: DataFrame, files: DataFrame, contents: DataFrame, match: str = "exact", page_files: int = 2000,
    slice_names: int = SLICE_NAMES,
) -> DataFrame:
    """Rebuilt diff of every pull request (R3): keys, ``page``, ``diff``, ``rebuilt``.

    Parts stand in file order, joined by newlines; a pull request without any keeps
    its original diff. One of more than ``page_files`` files comes in ordered pages.
    """
    groups = split_by_size(
        diff_parts(prs, files, contents, match, slice_names), PR, page_files, sized_by=reviewable_files(files).select(*PR)
    )
    first = F.lit(0).cast("bigint").alias("page")
    whole = _joined(groups.small.withColumn("page", first).repartition(*PR)).select(*PR, F.col("diff").alias("_rebuilt"))
    small = prs if groups.large is None else attach_by_key(prs, groups.large_keys, PR, "left_anti")
    result = small.join(whole, PR, "left").select(
        *PR, first, F.coalesce("_rebuilt", "diff").alias("diff"), F.col("_rebuilt").isNotNull().alias("rebuilt")
    )
    if groups.large is None:
        return result
    numbered = number_pages(groups.large, PR, [F.col("seq")], page_files)
    pages = _joined(numbered.repartition(*PR, "page"))
    large = attach_by_key(prs, groups.large_keys, PR, "left_semi")
    untouched = attach_by_key(large, groups.large.select(*PR).distinct(), PR, "left_anti")
    return result.unionByName(pages.withColumn("rebuilt", F.lit(True))).unionByName(
        untouched.select(*PR, first, "diff", F.lit(False).alias("rebuilt"))
    )


def resolved_diffs(prs: DataFrame, files: DataFrame, contents: DataFrame, **rebuilding) -> DataFrame:
    """The diff to review (P7, P8): the original, or the rebuilt one where the original
    holds a binary marker. Only files of those pull requests are looked at."""
    marked = has_binary_marker(F.col("diff"))
    doubtful = prs.where(marked)
    theirs = attach_by_key(files, doubtful.select(*PR).distinct(), PR, "left_semi")
    plain = prs.where(~marked).select(
        *PR, F.lit(0).cast("bigint").alias("page"), "diff", F.lit(False).alias("rebuilt")
    )
    return plain.unionByName(rebuild_diff(doubtful, theirs, contents, **rebuilding))


def _joined(paged_parts: DataFrame) -> DataFrame:
    texts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "part"))), lambda p: p["part"])
    return paged_parts.groupBy(*PR, "page").agg(F.array_join(texts, "\n").alias("diff"))

"""Functions over file paths, file contents and diffs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffmill.fixed import (
    DECISION_KEYWORDS,
    DECISION_OPERATORS,
    LANGUAGES,
    MEASURED_LANGUAGES,
    PROMPT_AFTER,
    PROMPT_BEFORE,
    SKIPPED_DIRECTORY,
    SYSTEM_PROMPT,
    UNICODE_SPACES,
)

# A line that opens a file's section. Flag d: only \n ends a line, as in the text split.
HEADER_LINES = r"(?md)^(diff --git.*)$"
SAME_NAME_HEADER = r"(?s)^diff --git a/(.+) b/\1$"
ANY_HEADER = r"(?s)^diff --git a/.* b/(.*)$"


def ext_of(path: Column) -> Column:
    """Lower-cased extension; a leading dot alone makes no extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, ``unknown`` for any other (G1)."""
    ext = ext_of(path)
    language = None
    for name in dict.fromkeys(LANGUAGES.values()):
        exts = [e for e, owner in LANGUAGES.items() if owner == name]
        language = F.when(ext.isin(exts), name) if language is None else language.when(ext.isin(exts), name)
    return language.otherwise("unknown")


def is_measured(language: Column) -> Column:
    """Whether complexity and lint counts apply to the language."""
    return language.isin(*MEASURED_LANGUAGES)


def is_code_path(path: Column) -> Column:
    """A code file outside hidden and dependency directories."""
    hidden = rf"(^|/)(\.[^/]*|{SKIPPED_DIRECTORY})(/|$)"
    return ~path.rlike(hidden) & ext_of(path).isin(list(LANGUAGES))


def line_count(text: Column) -> Column:
    """Newlines + 1, so the empty file has one line."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + 1).cast("int")


def decision_pattern() -> str:
    """All decision points in one alternation: no two of them can overlap, so one
    pass counts what separate passes would. A look at the first character rejects most
    positions at once. ``\\b`` is spelled out because Java's treats accented letters as
    word characters."""
    keywords = "|".join(DECISION_KEYWORDS)
    operators = "|".join(re.escape(o) for o in DECISION_OPERATORS)
    first = "".join(sorted({w[0] for w in DECISION_KEYWORDS + DECISION_OPERATORS}))
    return rf"(?=[{first}])(?:(?<![A-Za-z0-9_])(?:{keywords})[\s{UNICODE_SPACES}]*\(|{operators})"


def cyclomatic(text: Column) -> Column:
    """1 + decision points."""
    return (F.regexp_count(text, F.lit(decision_pattern())) + 1).cast("int")


def has_binary_marker(diff: Column) -> Column:
    """The marker git prints in place of a binary change."""
    return F.coalesce(diff.rlike(r"Binary files [^\n\r\x{2028}\x{2029}]* differ"), F.lit(False))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, where an emoji counts two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def header_path(header: Column) -> Column:
    """File named by a ``diff --git`` line (the new name where it was renamed)."""
    same = F.regexp_extract(header, SAME_NAME_HEADER, 1)
    return F.when(same != "", same).otherwise(F.regexp_extract(header, ANY_HEADER, 1))


def diff_paths(diff: Column) -> Column:
    """Non-blank paths a diff touches, in order."""
    headers = F.regexp_extract_all(diff, F.lit(HEADER_LINES), F.lit(1))
    return F.filter(F.transform(headers, header_path), lambda p: F.trim(p) != "")


def added_lines(diff: Column) -> Column:
    """Lines a diff adds; the ``+++`` file line is none of them."""
    return F.regexp_count(diff, F.lit(r"(?md)^\+(?!\+\+ )")).cast("bigint")


def short_sha(sha: Column, n: int = 8) -> Column:
    """First characters of a commit id (G17): 8 on pages, 7 in diff headers."""
    return F.substring(sha, 1, n)


def preview(text: Column, n: int, utf16: bool = True) -> Column:
    """First n characters for a log or list (G23): UTF-16 units, or code points.

    A character of two units counts as two and is left out where only one is left. For
    counting, each gets a mark (U+FFFF, which is no character) in front.
    """
    start = F.substring(text, 1, n)
    if not utf16:
        return start
    marked = F.regexp_replace(start, r"([\x{10000}-\x{10FFFF}])", "\uffff$1")
    return F.replace(F.substring(marked, 1, n), F.lit("\uffff"), F.lit(""))


def prompt(diff: Column, with_system: bool = False) -> Column:
    """Review prompt around a diff."""
    before = f"{SYSTEM_PROMPT}\n\n{PROMPT_BEFORE}" if with_system else PROMPT_BEFORE
    return F.concat(F.lit(before), diff, F.lit(PROMPT_AFTER))

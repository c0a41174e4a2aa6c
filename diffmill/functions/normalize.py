"""Functions that bring findings, scores and labels to their stored form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffmill.fixed import FAIR_SCORE, FINDING_TYPES, GOOD_SCORE, SEVERITIES, TYPE_WORDS


def _one_pass(raw: Column) -> Column:
    low = F.lower(raw)
    kind = None
    for words, name in TYPE_WORDS:
        hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.when(low.isin(*FINDING_TYPES), low).otherwise("suggestion")


def normalize_type(raw: Column, null_mode: str = "suggestion", persisted: bool = False) -> Column:
    """One of the four finding types.

    ``null_mode='fail'`` leaves NULL for the caller to fail the review on.
    ``persisted=True`` gives the stored form, which is normalized twice; the word
    ``issue`` then turns every security finding into a code smell.
    """
    if null_mode not in ("suggestion", "fail"):
        raise ValueError("null_mode is 'suggestion' or 'fail'")
    once = _one_pass(raw)
    result = _one_pass(once) if persisted else once
    return F.when(raw.isNotNull(), result) if null_mode == "fail" else result


def normalize_severity(raw: Column) -> Column:
    """One of the four severities, else ``low``."""
    low = F.lower(raw)
    return F.when(low.isin(*SEVERITIES), low).otherwise("low")


def severity_rank(severity: Column) -> Column:
    """1 for low to 4 for critical, 0 for anything else."""
    rank = F.when(severity == SEVERITIES[0], 1)
    for i, name in enumerate(SEVERITIES[1:], start=2):
        rank = rank.when(severity == name, i)
    return rank.otherwise(0)


def null_if_falsy(value: Column, numeric: bool = False) -> Column:
    """'' or 0 to NULL."""
    return F.nullif(value, F.lit(0) if numeric else F.lit(""))


def is_missing(value: Column, numeric: bool = False) -> Column:
    """NULL, '' or 0 (P5)."""
    return value.isNull() | (value == (F.lit(0) if numeric else F.lit("")))


def score_band(score: Column) -> Column:
    """good, fair or poor; none without a score."""
    return (
        F.when(score.isNull(), "none")
        .when(score >= GOOD_SCORE, "good")
        .when(score >= FAIR_SCORE, "fair")
        .otherwise("poor")
    )


def type_label(kind: Column, upper: bool = True) -> Column:
    """First underscore to a blank; upper case in comments, capitalized on pages."""
    spaced = F.regexp_replace(kind, "^([^_]*)_", "$1 ")
    return F.upper(spaced) if upper else F.initcap(spaced)


def location(path: Column, line: Column) -> Column:
    """``path`` or ``path:line``; empty without a path."""
    no_line = is_missing(line, numeric=True)
    where = F.when(no_line, path).otherwise(F.concat(path, F.lit(":"), line.cast("string")))
    return F.when(is_missing(path), "").otherwise(where)

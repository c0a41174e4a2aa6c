"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Every text gets four statistics, transformed so that clean texts lie close together: word length,
rate of symbols, share of repeated lines, and share of words that repeat the word before. For each
language and source the MCD looks for the three quarters of rows whose covariance has the
smallest determinant; rows far from that core by Mahalanobis distance are rejected.

The estimate is found by concentration steps. One step is one Spark aggregation: distances under
the present estimate are put into fixed bins, every (group, bin) sums counts, values and products,
and the nearest bins that hold three quarters of a group give the next estimate. Sums are combined
in each task, so a group of any size costs one row per bin and task. Values are whole numbers of
1/1024, so sums are exact and reruns agree. Estimates are small tables written to the shared folder;
Spark broadcasts them if they are small and joins them by shuffle otherwise.

Most clean texts have no symbol and no repetition at all, where a plain covariance is singular; a
fixed floor is added to each variance. Groups of under ``MIN_GROUP`` rows are judged by the rows of all
such groups in their language.

Defined results: a null, empty or blank text has all statistics 0 and fails the base rule; null
languages and sources are groups like others; where even the pooled group has under ``MIN_POOL`` rows
only the base rule judges; equal rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import WHITE, judged, shingle_hashes, word_hashes
from diffmill.session import stored

#: Transformed statistics, and what is added to each standard deviation. The last two are under 1, so their floors
#: must be under 0.187 (1 / sqrt(CUTOFF)) for one of them alone to reject a text.
VECTOR = ("word_length", "symbol_rate", "line_repeats", "stutter")
FLOORS = (0.25, 0.4, 0.1, 0.1)
#: Share of rows in the core, concentration steps, chance that a Gaussian row is rejected.
CORE, STEPS, TAIL = 0.75, 5, 1e-5
MIN_GROUP, MIN_POOL = 100, 20
_UNIT = 1024

STATISTICS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_stutter bigint"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


def text_statistics(raw: bytes | None) -> dict[str, int]:
    names = [f.split()[0] for f in STATISTICS.split(", ")]
    if not raw:
        return dict.fromkeys(names, 0)
    words = word_hashes(raw)[0]
    n, b = len(words), np.frombuffer(raw, np.uint8)
    chars = int(np.count_nonzero(((b & 0xC0) != 0x80) & ~_IS_WHITE[b]))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    repeated = 0
    if n >= 5:
        windows = shingle_hashes(words)
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at, change = np.flatnonzero(np.isin(windows, twice)), np.zeros(n + 1, np.int64)
            change[at] += 1
            change[at + 5] -= 1
            repeated = int(np.count_nonzero(np.cumsum(change)[:n]))
    stutter = int(np.count_nonzero(words[1:] == words[:-1]))
    counts = (n, chars, int(np.count_nonzero(_SYMBOL[b])), len(lines), len(lines) - len(set(lines)), repeated, stutter)
    return dict(zip(names, counts))


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and the statistics of each text, without a shuffle."""
    return judged(docs, keep, text_col, lambda: text_statistics, STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    """Transformed statistics in whole units; null for a text without words."""
    per_word = lambda c: F.col(c) / F.nullif(F.col("n_words"), F.lit(0))
    values = (
        F.log2(per_word("word_chars")),
        F.log2(1 + 64 * F.col("n_symbols") / F.nullif(F.col("word_chars"), F.lit(0))),
        F.sqrt(F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))),
        F.sqrt(per_word("n_stutter")),
    )
    return [F.rint(v * _UNIT).cast("bigint").alias(name) for v, name in zip(values, VECTOR)]


def _tail(x: float, degrees: int) -> float:
    """Chance that a chi-squared value of even degrees exceeds x."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi2_quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _tail(middle, degrees) > tail else (low, middle)
    return high


D = len(VECTOR)
CUTOFF = chi2_quantile(TAIL, D)
#: Makes the core's covariance that of all rows, were they Gaussian.
WIDEN = CORE / (1 - _tail(chi2_quantile(1 - CORE, D), D + 2))
ESTIMATE = "gid string, start int, mean array<double>, inverse array<double>, log_det double"


def _estimate(gid: str, start: int, n: int, sums: np.ndarray, products: np.ndarray, widen: float) -> dict:
    mean = sums / n
    cov = (products / n - np.outer(mean, mean)) * widen / _UNIT**2 + np.diag(np.square(FLOORS))
    return _row(gid, start, mean, cov)


def _row(gid: str, start: int, mean: np.ndarray, cov: np.ndarray) -> dict:
    inverse = np.linalg.inv(cov) / _UNIT**2
    return {"gid": gid, "start": start, "mean": mean.tolist(), "inverse": inverse.ravel().tolist(),
            "log_det": float(np.linalg.slogdet(cov)[1])}


def _median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    total = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def _first(rows: pd.DataFrame) -> pd.DataFrame:
    """Start 0 of a group: medians and median deviations, from its histograms."""
    mean, spread = np.zeros(D), np.zeros(D)
    for d, part in rows.groupby("d"):
        values, counts = part["value"].to_numpy(float), part["n"].to_numpy()
        mean[d] = _median(values, counts)
        spread[d] = 1.4826 * _median(np.abs(values - mean[d]), counts) / _UNIT
    return pd.DataFrame([_row(rows["gid"].iloc[0], 0, mean, np.diag(np.square(spread) + np.square(FLOORS)))])


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _next(rows: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of a group from its bins, nearest first."""
    rows = rows.sort_values("bin")
    total = np.cumsum(rows["n"].to_numpy())
    core = rows.iloc[: 1 + int(np.searchsorted(total, math.ceil(CORE * total[-1])))]
    gid, start, n = core["gid"].iloc[0], int(core["start"].iloc[0]), int(core["n"].sum())
    products = np.zeros((D, D))
    for i, j in _PAIRS:
        products[i, j] = products[j, i] = float(core[f"p{i}{j}"].sum())
    sums = np.array([float(core[f"s{i}"].sum()) for i in range(D)])
    return pd.DataFrame([_estimate(gid, start, n, sums, products, WIDEN)])


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector under the row's estimate."""
    off = [F.col(v) - F.col("mean")[i] for i, v in enumerate(VECTOR)]
    return sum(off[i] * off[j] * F.col("inverse")[D * i + j] * (1 if i == j else 2) for i, j in _PAIRS)


def _with_estimates(rows: DataFrame, estimates: DataFrame, groups: list[str]) -> DataFrame:
    named = estimates.withColumnsRenamed({g: f"_{g}" for g in groups})
    same = [rows[g].eqNullSafe(named[f"_{g}"]) for g in groups]
    return rows.join(named, same, "left").drop(*[f"_{g}" for g in groups])


def fit(stats: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """One estimate for each language and source: groups, gid, start, mean, inverse, log_det.

    ``stats`` is read once for the vectors, which are stored; each step reads those.
    """
    groups = ["lang", "source"] if groups is None else groups
    rows = stored(stats.where("n_words > 0").select(*groups, *_vector()), "mcd-vectors")
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    own = F.to_json(F.struct(F.lit("own").alias("k"), *groups))
    pool = F.to_json(F.struct(F.lit("pool").alias("k"), *groups[:-1]))
    sizes = sizes.withColumn("gid", F.when(F.col("n") >= MIN_GROUP, own).otherwise(pool))
    pools = sizes.groupBy("gid").agg(F.sum("n").alias("_n")).where(F.col("_n") >= MIN_POOL)
    members = stored(sizes.join(pools.select("gid"), "gid").select(*groups, "gid"), "mcd-groups")

    grouped = _with_estimates(rows, members, groups).where("gid is not null")
    step = _UNIT // 64
    value = F.posexplode(F.array(*[F.floor(F.col(v) / step) * step for v in VECTOR])).alias("d", "value")
    histograms = grouped.select("gid", value).groupBy("gid", "d", "value").agg(F.count("*").alias("n"))
    plain = grouped.groupBy("gid").agg(F.lit(1).alias("start"), F.lit(0).alias("bin"), *_sums())
    estimates = histograms.groupBy("gid").applyInPandas(_first, ESTIMATE).unionByName(
        plain.groupBy("gid").applyInPandas(_next, ESTIMATE)
    )
    for _ in range(STEPS):
        named = stored(members.join(estimates, "gid"), "mcd-estimates")
        near = _with_estimates(rows, named, groups).where("gid is not null")
        binned = near.withColumn("bin", F.floor(16 * F.log2(_distance() + 2**-10)).cast("int"))
        summed = binned.groupBy("gid", "start", "bin").agg(*_sums())
        estimates = summed.groupBy("gid", "start").applyInPandas(_next, ESTIMATE)
    best = F.min_by(F.struct("start", "mean", "inverse", "log_det"), F.struct("log_det", "start"))
    least = estimates.groupBy("gid").agg(best.alias("e")).select("gid", "e.*")
    return stored(members.join(least, "gid"), "mcd-model")


def _sums() -> list[Column]:
    return [
        F.count("*").alias("n"),
        *[F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)],
        *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}{j}") for i, j in _PAIRS],
    ]


def verdicts(stats: DataFrame, model: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``stats`` with distance (null where there is no estimate), base_failed and kept."""
    groups = ["lang", "source"] if groups is None else groups
    held = _with_estimates(stats.select("*", *_vector()), model, groups)
    far = F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return (
        held.withColumn("distance", _distance())
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~far)
        .select(*stats.columns, "distance", "base_failed", "kept")
    )


def judge_quality(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, lang, source with statistics, distance, base_failed and kept, one row for each of ``docs``.

    The statistics are stored, so texts are read once."""
    keep = ["doc_id"] if keep is None else keep
    stats = stored(statistics(docs, list(dict.fromkeys([*keep, "lang", "source"])), text_col), "mcd-statistics")
    return verdicts(stats, fit(stats))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Whole rows never move for the estimate: texts are read twice, once for the statistics
    and once for the verdict."""
    whole = docs.select(F.struct("*").alias("_row"), *[docs[c] for c in dict.fromkeys([text_col, "lang", "source"])])
    stats = stored(statistics(whole, ["lang", "source"], text_col), "mcd-statistics")
    judged_rows = verdicts(statistics(whole, ["_row", "lang", "source"], text_col), fit(stats))
    return judged_rows.where("kept").select("_row.*")

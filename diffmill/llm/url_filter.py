"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and the start of a path. A URL can fit only the rules named by its own candidate keys: the
last labels of its host, as many as some rule has, followed by the start of its path, as long as some
rule's. All candidate keys of the corpus are the universe, and a cascade makes membership exact in it: the first
Bloom filter holds the listed keys; the second holds the universe's other keys that the first takes for
listed; the third the listed keys that the second takes for those; and so on until no key is taken wrongly.
A key is listed if the first filter that lacks it has an even number (counting from one).

Judging a URL then tests a few bits of each candidate, without a join and without moving a row. A filter is a
one-row table read as a scalar subquery. Its size follows the list and the logarithm of the universe: the
first filter errs on about half as many keys as are listed, every later one halves what is left.

Defined results: a null URL or one without "://" has empty host and path and fits no rule; a key that is listed
both ways blocks; without a fitting rule the verdict is the default; repeated rows and rules change
nothing; an empty list or table is no special case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.session import stored

#: Verdict, host and start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """verdict, host, path, one row per rule."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    empty = F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate(host: Column, path: Column, labels: int, size: int) -> Column:
    """The key that a rule with so many labels in its host and a path so long could list, else null."""
    has = (F.size(F.split(host, r"\.", -1)) >= labels) & (F.length(path) >= size)
    return F.when(has, F.concat(F.substring_index(host, ".", -labels), F.left(path, F.lit(size))))


class Cascade:
    """Exact membership of listed keys among the keys of a universe."""

    def __init__(self, keys: DataFrame):
        """``keys`` holds each key of the universe once, and whether it is ``listed``."""
        self.filters: list[tuple[DataFrame, int, int]] = []
        n_in = keys.where("listed").count()
        n_out = keys.count() - n_in
        inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
        error = min(0.5, n_in / (2 * n_out)) if n_in and n_out else 0.5
        while n_in:
            self.filters.append(self._filter(keys.sparkSession, inside, n_in, error))
            # what this filter takes wrongly is the next one's content, and its content the next one's test
            wrong = stored(outside.where(self._holds(F.col("key"), len(self.filters) - 1)), "cascade-errors")
            inside, outside, n_in, error = wrong, inside, wrong.count(), 0.5

    def _places(self, key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        first, step = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1))
        spread = lambda i: F.shiftrightunsigned(F.xxhash64(first, step, F.lit(i)), 1)
        return [spread(i) % F.lit(bits) for i in range(hashes)]

    def _filter(self, spark: SparkSession, keys: DataFrame, n: int, error: float) -> tuple[DataFrame, int, int]:
        words = 1 + math.ceil(-n * math.log(error) / math.log(2) ** 2 / 64)
        hashes = max(1, round(words * 64 / n * math.log(2))) if n > 8 else max(1, round(-math.log2(error)))
        hashes = min(hashes, 16)
        places = F.explode(F.array(*self._places(F.col("key"), len(self.filters), 64 * words, hashes))).alias("at")
        set_bits = keys.select(places).select(
            F.floor(F.col("at") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int")).alias("bits")
        )
        none = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
        filled = set_bits.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])
        return stored(filled.agg(ordered.alias("bits")), "cascade-filter"), 64 * words, hashes

    def _holds(self, key: Column, level: int) -> Column:
        rows, bits, hashes = self.filters[level]
        words = rows.scalar()
        tests = [
            F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1
            for at in self._places(key, level, bits, hashes)
        ]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.filters) % 2 == 1)
        for level in reversed(range(len(self.filters))):
            answer = F.when(~self._holds(key, level), F.lit(level % 2 == 1)).otherwise(answer)
        return answer


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """The ``keep`` columns (page_id) with host, path, rule (the longest key that fits, else null) and verdict."""
    keep = ["page_id"] if keep is None else keep
    rules = rules.where("host is not null and path is not null")
    shape = F.struct(F.size(F.split("host", r"\.", -1)).alias("n"), F.length("path").alias("size"))
    # as many as there are pairs of label count and path length in the list
    shapes = sorted((r.s.n, r.s.size) for r in rules.select(shape.alias("s")).distinct().collect())
    listed = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.bool_or(F.col("verdict") == "block").alias("blocks"))
    host, path = host_and_path(pages[url_col])
    placed = pages.select(*[pages[c] for c in keep], host.alias("host"), path.alias("path"))
    keys = [f"_key{i}" for i in range(len(shapes))]
    placed = placed.withColumns({c: candidate(F.col("host"), F.col("path"), *x) for c, x in zip(keys, shapes)})
    every = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")
    seen = placed.select(F.explode(every).alias("key")).distinct().withColumn("blocks", F.lit(None).cast("boolean"))
    universe = stored(seen.unionByName(listed).groupBy("key").agg(F.bool_or("blocks").alias("blocks")), "url-universe")
    any_rule = Cascade(universe.select("key", F.col("blocks").isNotNull().alias("listed")))
    blocking = Cascade(universe.select("key", F.coalesce("blocks", F.lit(False)).alias("listed")))
    fits = [F.when(any_rule.lists(F.col(k)), F.struct(F.length(k).alias("n"), F.col(k).alias("key"))) for k in keys]
    none = F.lit(None).cast("struct<n:int,key:string>")
    longest = F.greatest(none, none, *fits)["key"]
    found = placed.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocking.lists(F.col("rule")), "block").otherwise("allow")
    return found.select(*keep, "host", "path", "rule", verdict.alias("verdict"))

"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four patterns with checks (email, ip, card, phone) find the base spans. Instances are tokens with a digit or an @;
digit groups set apart by single spaces are one instance. The words before an instance are its lexical patterns: the
last two and the last one, or the ``key=`` or ``key:`` that it starts with. ``#`` stands for an earlier instance
among those words and ``^`` for the start of the text; a pattern names at least one word.

Seeds are the instances that a base span touches, and long random keys (32 letters and digits or more, of both
kinds). Patterns and instances form a graph. Each round scores a pattern by the trusted share of its distinct
instances and an instance by the patterns that name it; patterns of high confidence and enough trusted instances
then mark their instances outside base spans as spans of kind ``context``. A random key is a seed, but becomes a
span only in such a context.

Matches are placed by lengths: a text split at a pattern gives the pieces between the matches, and the running
length of pieces and matches is each match's start, in code points. Texts are read once, and what is found
is stored; texts never move. Edges are distinct before they are scored, and both scores are combined in each task.

The patterns are written so that Java's matcher neither recurses per character nor looks at a long run twice;
they match what the contract's patterns match (see the tests).

Defined results: a null or empty text has no spans; rows equal in id and text have equal spans; a null id is an
id like others; a corpus without seeds trusts no pattern; an empty table gives an empty result. Words, keys and
instances of any length take part; patterns above 128 characters are named by their hash. Patterns equal in
confidence all count. Only the id and text columns are read, so other columns may have any names. A text of megabytes
is judged whole in one row; its time grows with its instances times its base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.session import stored

_LOCAL = "A-Za-z0-9._%+-"
#: In the order in which spans are listed.
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MARKS = r"[.,;:!?)\"']*+"
_GROUP = rf"[(+]?[0-9][0-9().-]*+(?={_MARKS}(?:\s|$))"
_KEY = r"[\p{L}_][\p{L}_-]*+[=:]"
#: Digit groups set apart by single spaces, else a token with a digit or an @.
_TOKEN = rf"(?<!\S)(?:{_KEY})?+{_GROUP}(?: {_GROUP})*+{_MARKS}|(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
#: What does not belong to an instance at its edges.
_LEFT, _RIGHT = ".,;:!?<[{\"'#$%&*|", ".,;:!?>)]}\"'#$%&*|"
_RANDOM = r"^(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{32,}$"
#: Names of patterns longer than this are hashed.
_LONG = 128
_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
#: Rounds of scoring, least confidence of a pattern, least number of trusted instances it names.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.6, 5
#: Instances that count as untrusted for every pattern, against patterns seen a few times.
PRIOR = 2

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_FOUND = "array<struct<piece:string,match:string,start:bigint>>"
#: Lengths added at a time.
_BLOCK = 64


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named inside."""
    return F.transform(F.array(value), use)[0]


def _before(lengths: Column, use) -> Column:
    """``use`` of a function from a position to the sum of the lengths before it.

    Sums of blocks, then of the blocks before each block, so a text of m matches costs about
    32 m + m * m / 8192 additions."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)
    first = lambda b: (b * _BLOCK + 1).cast("int")
    sums = F.transform(blocks, lambda b: total(F.slice(lengths, first(b), _BLOCK)))

    def within(starts: Column) -> Column:
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        return use(lambda i: F.get(starts, block(i)) + total(F.slice(lengths, first(block(i)), i % _BLOCK)))

    return _let(sums, lambda s: _let(F.transform(blocks, lambda b: total(F.slice(s, F.lit(1), b))), within))


def located(text: Column, pattern: str) -> Column:
    """Every match with its start and the text between it and the match before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(_FOUND)

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: (F.length(p["piece"]) + F.coalesce(F.length(p["match"]), F.lit(0))).cast("bigint"))

        def one(before):
            place = lambda p, i: F.struct(
                p["piece"].alias("piece"), p["match"].alias("match"), (before(i) + F.length(p["piece"])).alias("start")
            )
            return F.filter(F.transform(parts, place), lambda f: f["match"].isNotNull())

        return _let(sizes, lambda lengths: _before(lengths, one))

    parts = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.when(F.size(matches) == 0, empty).otherwise(_let(parts, placed))


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled, and the others sum to a multiple of ten."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_PARTS),
    "card": lambda m: _luhn(F.translate(m, " -", "")),
    "phone": lambda m: F.regexp_count(m, F.lit("[0-9]")).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(located(text, KINDS[kind]), lambda f: _CHECKS[kind](f["match"]))
    span = lambda f: F.struct(F.lit(kind).alias("kind"), f["start"].alias("start"), (f["start"] + F.length(f["match"])).alias("end"))
    return F.transform(found, span)


def _words(piece: Column) -> Column:
    return F.filter(F.split(piece, r"\s+"), lambda w: w != "")


def _patterns(parts: Column, i: Column, key: Column) -> Column:
    """The lexical patterns of instance ``i``: its key, or the last two words before it and the last one."""
    last = lambda words, n: F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n)
    first = F.array(F.lit("^"))
    earlier = F.concat(last(F.concat(first, _words(F.get(parts, i - 1)["piece"])), 1), F.array(F.lit("#")))
    known = F.when(i > 0, earlier).otherwise(first)

    def named(context: Column) -> Column:
        one, two = F.element_at(context, -1), F.array_join(last(context, 2), " ")
        return F.filter(F.array_distinct(F.array(one, two)), lambda p: ~p.rlike(r"^[#^](?: [#^])?$"))

    spoken = _let(F.transform(F.concat(known, last(_words(parts[i]["piece"]), 2)), F.lower), named)
    return F.transform(F.when(key != "", F.array(F.lower(key))).otherwise(spoken), lambda p: F.when(F.length(p) > _LONG, F.sha2(p, 256)).otherwise(p))


def _instances(text: Column, base: Column) -> Column:
    """Tokens with a digit or an @: patterns, instance (a hash), start, end, whether a base span touches it, and
    whether it is a seed."""

    def one(parts: Column):
        def at(f: Column, i: Column) -> Column:
            key = F.when(f["match"].rlike(f"^{_KEY}[^/]"), F.regexp_extract(f["match"], f"^{_KEY}", 0)).otherwise("")

            def placed(k: Column) -> Column:
                token = F.substr(f["match"], F.length(k) + 1)
                right = F.ltrim(token, F.lit(_LEFT))
                start = f["start"] + F.length(k) + F.length(token) - F.length(right)
                return F.struct(k.alias("key"), F.rtrim(right, F.lit(_RIGHT)).alias("value"), start.alias("start"))

            def judged(x: Column) -> Column:
                end = x["start"] + F.length(x["value"])
                held = F.exists(base, lambda s: (s["start"] < end) & (x["start"] < s["end"]))
                return F.struct(
                    _patterns(parts, i, x["key"]).alias("patterns"), F.xxhash64(F.lower(x["value"])).alias("instance"),
                    x["start"].alias("start"), end.alias("end"), held.alias("held"), (held | x["value"].rlike(_RANDOM)).alias("seed"),
                )

            return _let(_let(key, placed), judged)

        return F.transform(parts, at)

    return F.filter(_let(located(text, _TOKEN), one), lambda t: t["end"] > t["start"])


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """pattern and confidence of those that pass. ``edges`` holds each pattern and instance once, with ``seed``."""
    edges = stored(edges, "pii-edges")
    trust = edges.withColumn("trust", F.col("seed").cast("double"))
    for turn in range(ROUNDS):
        scored = trust.groupBy("pattern").agg(
            (F.sum("trust") / (F.count("*") + PRIOR)).alias("confidence"), F.sum((F.col("trust") >= 0.5).cast("int")).alias("support")
        )
        passed = scored.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern", "confidence")
        passed = stored(passed.withColumn("confidence", F.round("confidence", 9)), "pii-patterns")
        if turn + 1 < ROUNDS:
            named = edges.join(passed, "pattern").groupBy("instance").agg(F.max("confidence").alias("trust"))
            named = named.withColumnRenamed("instance", "_instance")
            trust = edges.join(named, F.col("instance") == F.col("_instance"), "left").select(
                "pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))).alias("trust")
            )
    return passed


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (spans by kind and start) and discovered (spans of kind ``context``), one row for each of ``docs``."""
    text = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_key"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = text.select("id", "text_key", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    found = found.withColumn("base", F.concat(*KINDS)).select("id", "text_key", "base", _instances(F.col("text"), F.col("base")).alias("tokens"))
    found = stored(found, "pii-found")
    tokens = found.select("id", "text_key", F.inline("tokens")).withColumn("pattern", F.explode("patterns")).drop("patterns")
    passed = trusted_patterns(tokens.groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed")))
    span = F.struct(F.lit("context").alias("kind"), "start", "end")
    new = tokens.where("not held").join(passed.select("pattern"), "pattern").groupBy("id", "text_key").agg(
        F.array_sort(F.collect_set(span)).cast(SPAN).alias("discovered")
    ).withColumnsRenamed({"id": "_id", "text_key": "_text_key"})
    same = found["id"].eqNullSafe(new["_id"]) & (found["text_key"] == new["_text_key"])
    return found.join(new, same, "left").select("id", "base", F.coalesce("discovered", F.array().cast(SPAN)).alias("discovered"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

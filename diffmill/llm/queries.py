"""Queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.llm import (
    byte_bpe, decontaminate, fill_middle, filter_audit, license_scan, lm_score, mixing, neardup, personal, quality, sharding,
    url_filter, wrappers,
)
from diffmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(names):
    """Distinct strings, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(names)), ",")


@query
def op1_license_scan(spark, sf_dir):
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("phrases", lambda p: p["start"])
    base, more = F.transform("phrases", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), "score", "spans",
    )


@query
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


_WORDS = (
    r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLES["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)
),
found AS (SELECT doc_id, size, i, item_id FROM places JOIN item_windows USING (size, win)),
hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY 1
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM found) GROUP BY 1
)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op3_quality_outliers(spark, sf_dir):
    judged = quality.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query
def op4_mix_sources(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("row.doc_id", "size", "source_size", "target", taken)


ORACLES["op4_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS symbols,
         (cast('0x' || substr(md5('mix-' || coalesce(cast(doc_id AS varchar), '')), 1, 12) AS bigint) + 0.5::double)
           / 281474976710656::double AS u
  FROM documents
),
k AS (SELECT *, -ln(u) * (1 + 20::double * symbols / greatest(size, 1)) AS key FROM d),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY 1),
w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         source_size * 2 AS cap, sum(source_size) OVER () * 1.5::double AS total
  FROM s
),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::double AS level
  FROM w
),
t AS (
  SELECT source, source_size,
         least(cap::double, max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight) AS target
  FROM l
),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS bigint) ELSE 0 END AS epochs FROM t
),
r AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS ahead
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, cast(size AS bigint) AS size, source_size, target,
       cast(size * (epochs + CASE WHEN rest > 0 AND ahead + size / 2 <= rest THEN 1 ELSE 0 END) AS bigint) AS taken
FROM r
"""


@query
def op9_hilbert_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs.select("doc_id", "lang", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "text")
    placed = sharding.shard(kept, columns=["doc_id", "crc"])
    return placed.select(
        "row.doc_id", "size", F.col("row.crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "index",
    )


@query
def op5_near_duplicates(spark, sf_dir):
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


_SHINGLES = r"""
words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
  ) JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * common >= 75 * (s.n + t.n - common)
)"""
ORACLES["op5_near_duplicates"] = f"""
WITH RECURSIVE {_SHINGLES},
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT r.doc_id, cast(coalesce(any_value(s.n), 0) AS bigint) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query
def op8_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
ORACLES["op8_url_filter"] = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
),
fit AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (page_id)
"""


@query
def op10_personal_data(spark, sf_dir):
    found = personal.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in personal.KINDS],
        F.sha2(personal.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        personal.listed(F.concat("base", "discovered")).alias("spans"),
    )


@query
def op6_lm_score(spark, sf_dir):
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@query
def op7_html_articles(spark, sf_dir):
    found = wrappers.extract_articles(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op11_fill_in_middle(spark, sf_dir):
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        fill_middle.restored_sha256(F.col("output"), F.col("form")).alias("restored_sha256"),
    )


ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), []) AS u,
         sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h
  FROM documents
),
e AS (SELECT *, len(u) AS n, [cast('0x' || substr(h, 8 * i + 1, 8) AS bigint) FOR i IN range(4)] AS x FROM d),
c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS low, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 90
              THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM e
),
p AS (
  SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS pre, coalesce(array_to_string(u[low + 1:high], ''), '') AS mid,
         coalesce(array_to_string(u[high + 1:], ''), '') AS suf
  FROM c
),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output
  FROM p
),
r AS (
  SELECT *, strpos(output, '<P>') AS p_at, strpos(output, '<S>') AS s_at, strpos(output, '<M>') AS m_at FROM o
)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN substr(output, p_at + 3, s_at - p_at - 3) || substr(output, m_at + 3) || substr(output, s_at + 3, m_at - s_at - 3)
              ELSE substr(output, p_at + 3, m_at - p_at - 3) || substr(output, m_at + 3) || substr(output, s_at + 3, p_at - s_at - 3) END)
         AS restored_sha256
FROM r
"""


@query
def op12_byte_bpe(spark, sf_dir):
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
),
firsts AS (SELECT text, min(doc_id) AS least_id FROM d GROUP BY 1),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least_id, false)} AS fails
  FROM d JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
),
g AS (SELECT part, fails, count(*) AS n, sum(good::int) AS n_good, sum(toxic::int) AS n_toxic FROM f GROUP BY ALL),
grown(o) AS (
  SELECT '' UNION ALL
  SELECT o || x FROM grown, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
),
steps AS (
  SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM grown WHERE length(o) = 5
),
s AS (
  SELECT g.*, filter_order, step, fails[substr(filter_order, step, 1)] AS hit,
         len(list_filter(range(1, step), lambda i: fails[substr(filter_order, i, 1)])) > 0 AS gone,
         len(list_filter(map_values(fails), lambda v: v)) = 1 AS alone
  FROM g, steps
),
t AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS name,
         sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND hit THEN n_good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND hit THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, cast(step AS int) AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
       unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, name) AS bigint) AS shapley
FROM t
"""

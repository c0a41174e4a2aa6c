"""The same results as plain SQL over the given tables, for the correctness check."""

from __future__ import annotations

import hashlib

from diffmill.fixed import (
    CANNED_RESPONSE,
    COMMENT_HEADING,
    COMMENT_LIST_HEADING,
    COMMENT_NO_ISSUES,
    COMMENT_RULE,
    COMMENT_SCORE,
    COMMENT_SIGNATURE,
    COMMENT_SUGGESTION,
    DEFAULT_DIAGRAM,
    EMPTY_DIAGRAM,
    LATENCY_BOUNDS_MS,
    PROMPT_AFTER,
    PROMPT_BEFORE,
    UNREACHABLE_RESPONSE,
)
from diffmill.plans import views as V

_SQL: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    return dict(_SQL)


def _text(value: str) -> str:
    """A SQL literal; line ends become chr(10)."""
    parts = [f"'{p}'" for p in value.replace("'", "''").split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _view(name: str, columns: dict[str, str], source: str, more: str = "", where: str = "") -> str:
    listed = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"{name} AS (SELECT {listed}{more} FROM {source}{where})"


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def _type(x: str) -> str:
    low = f"lower({x})"
    return (
        f"CASE WHEN {x} IS NULL THEN 'suggestion' "
        f"WHEN contains({low}, 'error') OR contains({low}, 'issue') OR contains({low}, 'bug') THEN 'code_smell' "
        f"WHEN contains({low}, 'security') OR contains({low}, 'vulnerability') THEN 'security_issue' "
        f"WHEN contains({low}, 'best') OR contains({low}, 'practice') OR contains({low}, 'pattern') THEN 'best_practice' "
        f"WHEN {low} IN ('code_smell', 'security_issue', 'suggestion', 'best_practice') THEN {low} "
        "ELSE 'suggestion' END"
    )


def _severity(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('low', 'medium', 'high', 'critical') THEN lower({x}) ELSE 'low' END"


RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
DAY = "'%Y-%m-%d %H:%M:%S'"

REVIEWS = _view("reviews", V.REVIEWS, "orders")
RAW_FINDINGS = _view("raw_findings", V.FINDINGS, "lineitem", ", " + ORDER)
FINDINGS = (
    RAW_FINDINGS
    + f""",
findings AS (SELECT review_id, {_type('type')} AS type, {_severity('severity')} AS severity,
  nullif(file_path, '') AS file_path, nullif(line_number, 0) AS line_number, message,
  nullif(suggestion, '') AS suggestion, created_at, {ORDER} FROM raw_findings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {RANK} DESC, {ORDER}) AS position
  FROM findings)"""
)
STATIC = _view("static_results", V.STATIC, "events")
LAST_STATIC = "last_static AS (SELECT job_id, max_by(static_metrics, offset_no) AS new FROM static_results GROUP BY job_id)"


def _location(path: str, line: str) -> str:
    return f"CASE WHEN {path} IS NULL THEN '' WHEN {line} IS NULL THEN {path} ELSE {path} || ':' || {line} END"


def _label(x: str) -> str:
    return f"regexp_replace({x}, '_', ' ')"


def _uml(x: str) -> str:
    return f"CASE WHEN json_valid({x}) THEN nullif(json_extract_string({x}, '$.uml_s3_url'), '') END"


# Findings and comments

_SQL["top3_findings"] = _with(FINDINGS) + (
    "SELECT review_id, CAST(position AS INTEGER) AS position, type, severity, message FROM ranked WHERE position <= 3"
)
_SQL["top10_findings"] = _with(FINDINGS) + (
    "SELECT review_id, CAST(position AS INTEGER) AS position, "
    "CASE type WHEN 'code_smell' THEN 'Code Smell' WHEN 'security_issue' THEN 'Security Issue' "
    "WHEN 'best_practice' THEN 'Best Practice' ELSE 'Suggestion' END AS label, "
    f"{_location('file_path', 'line_number')} AS location, message FROM ranked WHERE position <= 10"
)
_COMMENTS = f""",
lines AS (SELECT review_id, string_agg(
    position || '. **' || upper({_label('type')}) || '** ' ||
    CASE WHEN file_path IS NULL THEN '' ELSE '(' || {_location('file_path', 'line_number')} || ') ' END ||
    '- ' || message || CASE WHEN suggestion IS NULL THEN '' ELSE {_text(COMMENT_SUGGESTION)} || suggestion END ||
    chr(10) || chr(10), '' ORDER BY position) AS listed
  FROM ranked WHERE position <= 3 GROUP BY review_id),
rendered AS (SELECT r.*, {_text(COMMENT_HEADING + COMMENT_SCORE[0])} ||
    coalesce(CAST(quality_score AS VARCHAR), 'null') || {_text(COMMENT_SCORE[1])} ||
    coalesce({_text(COMMENT_LIST_HEADING)} || listed, {_text(COMMENT_NO_ISSUES)}) ||
    {_text(COMMENT_RULE + COMMENT_SIGNATURE)} AS body
  FROM reviews r LEFT JOIN lines ON r.id = lines.review_id)
"""
_SQL["render_comment"] = _with(REVIEWS, FINDINGS) + _COMMENTS + "SELECT id, body FROM rendered"
_SQL["comment_outbox"] = _with(REVIEWS, FINDINGS) + _COMMENTS + (
    "SELECT id, repo, pr_number, body FROM rendered WHERE status = 'done' AND github_comment_id IS NULL"
)
_SQL["normalize_types"] = _with(RAW_FINDINGS) + (
    f"SELECT type AS raw_type, {_type('type')} AS type, count(*) AS n FROM raw_findings GROUP BY ALL"
)
_SQL["persisted_types"] = _with(RAW_FINDINGS) + (
    f"SELECT raw_type, {_type('once')} AS type, count(*) AS n "
    f"FROM (SELECT type AS raw_type, {_type('type')} AS once FROM raw_findings) GROUP BY ALL"
)
_SQL["normalize_severity"] = _with(RAW_FINDINGS) + (
    f"SELECT severity AS raw_severity, {_severity('severity')} AS severity, count(*) AS n "
    "FROM raw_findings GROUP BY ALL"
)
_SQL["out_of_domain"] = _with(RAW_FINDINGS) + (
    "SELECT severity, count(*) AS n FROM raw_findings "
    "WHERE coalesce(severity NOT IN ('low', 'medium', 'high', 'critical'), true) GROUP BY severity"
)
_SQL["order_findings"] = _with(FINDINGS) + (
    f"SELECT review_id, severity, strftime(created_at, {DAY}) AS created_at, message, l_extendedprice FROM findings "
    f"ORDER BY review_id, {RANK} DESC, findings.created_at DESC, {ORDER}"
)
_SQL["review_detail"] = _with(REVIEWS, FINDINGS) + f""",
numbered AS (SELECT *, (row_number() OVER (PARTITION BY review_id ORDER BY {RANK} DESC, created_at DESC, {ORDER}) - 1)
    // 50000 AS page FROM findings),
nested AS (SELECT review_id, page, count(*) AS n, string_agg(concat_ws('|', type, severity, coalesce(file_path, '-'),
    coalesce(CAST(line_number AS VARCHAR), '-'), message, coalesce(suggestion, '-')), ';'
    ORDER BY {RANK} DESC, created_at DESC, {ORDER}) AS listed FROM numbered GROUP BY review_id, page)
SELECT id, job_id, repo, pr_number, commit_sha, status, quality_score, {_uml('static_metrics')} AS uml_s3_url,
  github_comment_id, strftime(created_at, {DAY}) AS created_at, coalesce(page, 0) AS page,
  coalesce(n, 0) AS n_findings, coalesce(listed, '') AS findings
FROM reviews LEFT JOIN nested ON id = review_id"""
_SQL["findings_count"] = _with(FINDINGS) + "SELECT review_id, count(*) AS findings FROM findings GROUP BY review_id"
_SQL["findings_by_severity"] = _with(FINDINGS) + (
    "SELECT type, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, "
    "count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical, "
    "count(*) AS findings FROM findings GROUP BY type"
)
_SQL["attach_review_id"] = _with(REVIEWS, FINDINGS) + (
    "SELECT r.id AS review_id, type, severity, message, l_extendedprice "
    "FROM findings f JOIN reviews r ON md5(CAST(f.review_id AS VARCHAR(20))) = r.job_id"
)

# Reviews

_LIST = f"SELECT id, repo, pr_number, status, quality_score, strftime(created_at, {DAY}) AS created_at FROM reviews"
_SQL["review_list"] = _with(REVIEWS) + _LIST
_SQL["latest_reviews"] = _with(REVIEWS) + _LIST + " ORDER BY reviews.created_at DESC, id LIMIT 10"
_SQL["review_by_id"] = _with(REVIEWS) + _LIST + " WHERE id = 42"
_SQL["findings_by_review"] = _with(FINDINGS) + (
    "SELECT review_id, type, severity, message FROM findings WHERE review_id = 77"
)
_SQL["review_by_job"] = _with(REVIEWS) + _LIST + " WHERE job_id = 'a1d0c6e83f027327d8461063f4ac58a6'"
_SQL["reviews_by_ids"] = _with(REVIEWS) + (
    "SELECT id, job_id FROM reviews WHERE id IN (SELECT event_id * 3 FROM events WHERE event_id % 3 <> 0)"
)
_SQL["status_counts"] = _with(REVIEWS) + "SELECT status, count(*) AS reviews FROM reviews GROUP BY status"
_BAND = (
    "CASE WHEN quality_score IS NULL THEN 'none' WHEN quality_score >= 80 THEN 'good' "
    "WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END"
)
_SQL["score_bands"] = _with(REVIEWS) + f"SELECT {_BAND} AS band, count(*) AS reviews FROM reviews GROUP BY 1"
_SQL["quality_trend"] = _with(REVIEWS) + (
    f"SELECT repo, strftime(date_trunc('month', created_at), {DAY}) AS period, count(*) AS reviews, "
    "CAST(sum(quality_score) AS BIGINT) AS score_sum, "
    "CAST(sum(quality_score) AS DOUBLE) / count(quality_score) AS mean_score, "
    "count(*) FILTER (quality_score >= 80) AS good, "
    "count(*) FILTER (quality_score >= 60 AND quality_score < 80) AS fair, "
    "count(*) FILTER (quality_score < 60) AS poor "
    "FROM reviews WHERE quality_score IS NOT NULL GROUP BY 1, 2"
)
_SQL["new_reviews"] = _with(REVIEWS) + (
    "SELECT job_id, repo, pr_number, commit_sha, 'pending' AS status, CAST(NULL AS INTEGER) AS quality_score, "
    "'2024-02-01 00:00:00' AS created_at FROM reviews"
)
_SQL["first_per_job"] = (
    "SELECT md5(CAST(user_id AS VARCHAR(20))) AS job_id, min(event_id) AS event_id, "
    "arg_min(event_type, event_id) AS kind, count(*) AS deliveries FROM events GROUP BY user_id"
)
_SQL["assign_ids"] = "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids FROM orders"
_SQL["id_collisions"] = (
    "SELECT o_orderkey % 997 AS id, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1"
)
_SQL["upsert_scores"] = _with(REVIEWS) + (
    "SELECT id, status, CASE WHEN event_id IS NOT NULL THEN event_id % 101 ELSE quality_score END AS quality_score "
    "FROM reviews LEFT JOIN events ON id = event_id * 2"
)
_STATE = f"""SELECT md5(CAST(user_id AS VARCHAR(20))) AS job_id, arg_max(status, k) AS status,
  strftime(min(ts), {DAY}) AS created_at,
  CASE WHEN arg_max(status, k) = 'done' THEN strftime(arg_max(ts, k), {DAY}) END AS completed_at
FROM (SELECT user_id, ts, {{'t': ts, 's': event_id}} AS k, CASE event_type WHEN 'error' THEN 'failed'
  WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' ELSE 'done' END AS status FROM events) GROUP BY user_id"""
_SQL["review_state"] = _STATE
_SQL["sha_matches"] = _with(_view("checkouts", V.CHECKOUTS, "orders")) + (
    "SELECT id, regexp_replace(head, '^\\s+|\\s+$', '', 'g') = sha AS matches FROM checkouts"
)
_SQL["apply_static"] = _with(REVIEWS, STATIC, LAST_STATIC) + (
    ", updated AS (SELECT id, coalesce(new, static_metrics) AS static_metrics "
    "FROM reviews LEFT JOIN last_static USING (job_id)) "
    f"SELECT id, static_metrics, {_uml('static_metrics')} AS uml_s3_url FROM updated"
)
_SQL["unmatched_static"] = _with(REVIEWS, STATIC) + (
    "SELECT offset_no, job_id FROM static_results WHERE job_id NOT IN (SELECT job_id FROM reviews)"
)
_SQL["delete_cascade_reviews"] = _with(REVIEWS, STATIC) + (
    "SELECT id, job_id FROM reviews WHERE job_id NOT IN (SELECT job_id FROM static_results)"
)
_SQL["delete_cascade_findings"] = _with(REVIEWS, FINDINGS, STATIC) + (
    "SELECT review_id, message, l_extendedprice FROM findings WHERE review_id NOT IN "
    "(SELECT id FROM reviews WHERE job_id IN (SELECT job_id FROM static_results))"
)
_SQL["reconcile"] = _with(REVIEWS, FINDINGS) + (
    ", counted AS (SELECT review_id, count(*) AS n FROM findings GROUP BY review_id) "
    "SELECT md5(CAST(event_id * 2 AS VARCHAR(20))) AS job_id, CASE WHEN r.id IS NULL THEN 'published' "
    "WHEN status IN ('done', 'failed') THEN status WHEN n > 0 THEN 'findings' "
    "WHEN static_metrics IS NOT NULL THEN 'static_metrics' ELSE 'review' END AS stage, "
    "static_metrics IS NOT NULL AS has_static, coalesce(n, 0) AS findings "
    "FROM events LEFT JOIN reviews r ON r.job_id = md5(CAST(event_id * 2 AS VARCHAR(20))) "
    "LEFT JOIN counted ON counted.review_id = r.id"
)

# Deliveries and messages

_KEY = V.SECRET.encode() if len(V.SECRET) <= 64 else hashlib.sha256(V.SECRET.encode()).digest()
_IPAD = bytes(b ^ 0x36 for b in _KEY.ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in _KEY.ljust(64, b"\0")).hex()
_DELIVERIES = (
    _view("sent", V.DELIVERIES, "events", ", event_type")
    + f""",
hashed AS (SELECT *, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(raw_body)))) AS expected
  FROM sent),
signed AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'error' THEN 'sha256=00'
  WHEN event_id % 19 = 0 THEN 'sha256=' || repeat('0', 64) ELSE 'sha256=' || expected END AS signature FROM hashed),
stated AS (SELECT *, CASE WHEN signature IS NULL THEN 'missing' WHEN length(signature) <> 71 THEN 'wrong_length'
  WHEN signature <> 'sha256=' || expected THEN 'wrong' ELSE 'valid' END AS state,
  json_extract_string(raw_body, '$.repository.full_name') AS repo,
  CAST(json_extract_string(raw_body, '$.pull_request.number') AS INTEGER) AS pr_number,
  json_extract_string(raw_body, '$.pull_request.head.sha') AS head_sha,
  json_extract_string(raw_body, '$.diff') AS inline_diff FROM signed),
classified AS (SELECT *, repo IS NULL OR repo = '' OR pr_number IS NULL OR pr_number = 0 OR head_sha IS NULL AS missing,
  CASE WHEN state = 'missing' THEN 'no_signature' WHEN state <> 'valid' THEN 'invalid_signature'
  WHEN event <> 'pull_request' THEN 'ignored' WHEN missing THEN 'missing_fields' ELSE 'accepted' END AS outcome
  FROM stated)
"""
)
_SQL["verify_signature"] = _with(_DELIVERIES) + "SELECT event_id, expected, state, state = 'valid' AS valid FROM stated"
_SQL["classify_delivery"] = _with(_DELIVERIES) + (
    "SELECT event_id, outcome, CAST(CASE outcome WHEN 'no_signature' THEN 401 WHEN 'invalid_signature' THEN 401 "
    "WHEN 'ignored' THEN 200 WHEN 'missing_fields' THEN 400 ELSE 202 END AS INTEGER) AS http_status FROM classified"
)
_SQL["extract_pr"] = _with(_DELIVERIES) + (
    "SELECT event_id, repo, pr_number, head_sha, json_extract_string(raw_body, '$.pull_request.base.sha') AS base_sha, "
    "inline_diff, missing FROM classified WHERE event = 'pull_request'"
)
_MESSAGE = (
    "md5(concat_ws(chr(31), repo, pr_number, head_sha, raw_body)) AS key, CAST(json_object("
    "'job_id', md5(concat_ws(chr(31), repo, pr_number, head_sha, raw_body)), 'repo', repo, 'pr_number', pr_number, "
    "'commit_sha', head_sha, 'diff', {diff}) AS VARCHAR) AS value FROM classified WHERE outcome = 'accepted'"
)
_SQL["review_requests"] = _with(_DELIVERIES) + "SELECT " + _MESSAGE.format(diff="coalesce(inline_diff, 'fetched ' || head_sha)")
_RAW_SCORES = _view("scored", {"event_id": "event_id", "raw": V.RAW_SCORES}, "events")
_SQL["quarantine"] = _with(_RAW_SCORES) + (
    "SELECT event_id, CASE WHEN raw = '' THEN 'blank' WHEN NOT json_valid(raw) THEN 'malformed' "
    "WHEN json_type(raw) <> 'OBJECT' THEN 'malformed' ELSE 'good' END AS reason FROM scored"
)
_SQL["parse_messages"] = (
    "SELECT event_id, 'j' || event_id AS job_id, 'r' AS repo, CAST(CASE WHEN event_id % 4 = 0 THEN 7 ELSE event_id END "
    "AS INTEGER) AS pr_number, CAST(NULL AS VARCHAR) AS commit_sha, CAST(NULL AS VARCHAR) AS diff "
    "FROM events WHERE event_id % 4 <> 1 AND event_id % 9 <> 0"
)

# Model responses

_DOC = (
    "CASE WHEN json_valid({raw}) THEN {raw} "
    "WHEN json_valid(regexp_extract({raw}, '(?s)```json(.*?)```', 1)) "
    "THEN regexp_extract({raw}, '(?s)```json(.*?)```', 1) ELSE {nothing} END"
)
_SCORED_DOC = _RAW_SCORES + ",\ndocs AS (SELECT event_id, " + _DOC.format(raw="raw", nothing="'{}'") + (
    " AS doc FROM scored),\ntyped AS (SELECT event_id, json_type(doc, '$.quality_score') AS kind, "
    "json_extract_string(doc, '$.quality_score') AS s FROM docs)\n"
)
_SQL["score_strict"] = _with(_SCORED_DOC) + (
    "SELECT event_id, CAST(CASE WHEN kind IN ('UBIGINT', 'BIGINT') AND CAST(s AS BIGINT) BETWEEN 0 AND 100 "
    "THEN CAST(s AS BIGINT) WHEN kind = 'BOOLEAN' THEN CASE s WHEN 'true' THEN 1 ELSE 0 END ELSE 80 END AS INTEGER) "
    "AS score FROM typed"
)
_CLAMP = (
    "CAST(CASE WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR kind = 'VARCHAR' AND regexp_full_match(s, '[+-]?[0-9]+') "
    "THEN greatest(0, least(100, trunc(CAST(s AS DOUBLE)))) "
    "WHEN kind = 'BOOLEAN' THEN CASE s WHEN 'true' THEN 1 ELSE 0 END ELSE 80 END AS INTEGER)"
)
_SQL["score_clamp"] = _with(_SCORED_DOC) + f"SELECT event_id, {_CLAMP} AS score FROM typed"
_RAW_RESPONSES = _view("answered", {"event_id": "event_id", "raw": V.RAW_FINDINGS}, "events")
_SQL["parse_response"] = _with(_RAW_RESPONSES) + (
    "SELECT event_id, json_valid(raw) AS readable, "
    "CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END AS is_object FROM answered"
)


def _responses(plain: bool) -> str:
    doc = "CASE WHEN json_valid(raw) THEN raw END" if plain else _DOC.format(raw="raw", nothing="'{}'")
    canned = "doc IS NULL OR json_type(doc) <> 'OBJECT'"
    odd = "NOT is_list AND json_type(doc, '$.findings') IS NOT NULL" if plain else "false"
    return _RAW_RESPONSES + f""",
docs AS (SELECT event_id, {doc} AS doc FROM answered),
lists AS (SELECT *, coalesce(json_type(doc, '$.findings') = 'ARRAY', false) AS is_list, {canned} AS canned FROM docs),
elements AS (SELECT event_id, unnest(CAST(json_extract(doc, '$.findings') AS JSON[])) AS e,
    generate_subscripts(CAST(json_extract(doc, '$.findings') AS JSON[]), 1) - 1 AS ordinal
  FROM lists WHERE is_list AND NOT canned),
checked AS (SELECT *, json_type(e) <> 'OBJECT' OR coalesce(json_type(e, '$.message') <> 'VARCHAR', false)
    OR coalesce(json_type(e, '$.line_number') = 'VARCHAR'
      AND NOT regexp_full_match(json_extract_string(e, '$.line_number'), '[0-9]+'), false) AS bad FROM elements),
flags AS (SELECT event_id, bool_or(bad) AS bad, count(*) AS n FROM checked GROUP BY event_id),
sourced AS (SELECT l.*, CASE WHEN canned THEN 'canned' WHEN coalesce(bad, false) OR ({odd}) THEN 'void' ELSE 'model' END
    AS source, coalesce(n, 0) AS n, json_type(doc, '$.quality_score') AS kind,
    json_extract_string(doc, '$.quality_score') AS s FROM lists l LEFT JOIN flags USING (event_id)),
answers AS (SELECT event_id, CASE WHEN source = 'model' THEN {_CLAMP} ELSE 80 END AS quality_score,
    CAST(CASE source WHEN 'canned' THEN 1 WHEN 'void' THEN 0 ELSE n END AS BIGINT) AS n_findings,
    CASE source WHEN 'canned' THEN {_text(DEFAULT_DIAGRAM)} WHEN 'void' THEN {_text(EMPTY_DIAGRAM)}
      ELSE coalesce(json_extract_string(doc, '$.plantuml'), {_text(DEFAULT_DIAGRAM)}) END AS plantuml, source
  FROM sourced),
model_findings AS (SELECT event_id, CAST(ordinal AS INTEGER) AS ordinal,
    {_type("json_extract_string(e, '$.type')")} AS type, {_severity("json_extract_string(e, '$.severity')")} AS severity,
    json_extract_string(e, '$.file_path') AS file_path,
    CAST(json_extract_string(e, '$.line_number') AS INTEGER) AS line_number,
    json_extract_string(e, '$.message') AS message, json_extract_string(e, '$.suggestion') AS suggestion
  FROM checked JOIN sourced USING (event_id) WHERE source = 'model'),
canned_findings AS (SELECT event_id, ordinal, f.* EXCLUDE (ordinal) FROM sourced, (VALUES {_rows(CANNED_RESPONSE)})
    f(ordinal, type, severity, file_path, line_number, message, suggestion) WHERE source = 'canned'),
all_findings AS (SELECT * FROM model_findings UNION ALL SELECT * FROM canned_findings)
"""


def _rows(response: dict) -> str:
    def value(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else _text(x)

    names = ("type", "severity", "file_path", "line_number", "message", "suggestion")
    return ", ".join(
        "(" + ", ".join([str(i), *[value(f[n]) for n in names]]) + ")" for i, f in enumerate(response["findings"])
    )


_SQL["review_responses"] = _with(_responses(False)) + "SELECT * FROM answers"
_SQL["review_responses_plain"] = _with(_responses(True)) + "SELECT * FROM answers"
_SQL["explode_findings"] = _with(_responses(False)) + "SELECT * FROM all_findings"
_SQL["run_reviews"] = _with(REVIEWS, _responses(False)) + (
    "SELECT job_id, 'done' AS status, CAST(coalesce(a.quality_score, 85) AS INTEGER) AS quality_score, "
    "'2024-02-01 00:00:00' AS created_at, '2024-02-01 00:00:00' AS completed_at "
    "FROM reviews LEFT JOIN answers a ON id = event_id * 2"
)
_SQL["run_findings"] = _with(REVIEWS, _responses(False)) + f""",
shown AS (SELECT job_id, f.* EXCLUDE (event_id) FROM reviews JOIN all_findings f ON id = event_id * 2
  UNION ALL SELECT job_id, f.* FROM reviews LEFT JOIN answers ON id = event_id * 2,
    (VALUES {_rows(UNREACHABLE_RESPONSE)}) f(ordinal, type, severity, file_path, line_number, message, suggestion)
  WHERE event_id IS NULL)
SELECT job_id, CAST(ordinal AS INTEGER) AS ordinal, {_type('type')} AS type, severity,
  nullif(file_path, '') AS file_path, CAST(nullif(line_number, 0) AS INTEGER) AS line_number, message,
  nullif(suggestion, '') AS suggestion FROM shown"""
_SQL["run_events"] = "SELECT 'orchestrator' AS service, 'done' AS status, count(*) AS reviews_total FROM orders"

# Files and metrics

_CODE = _view("code", V.CODE, "documents")
_EXT = "lower(regexp_extract(regexp_extract({p}, '([^/]*)/*$', 1), '^.+(\\.[^.]*)$', 1))"
_LANGUAGE = (
    "CASE WHEN ext IN ('.js', '.jsx') THEN 'javascript' WHEN ext IN ('.ts', '.tsx') THEN 'typescript' "
    "WHEN ext = '.java' THEN 'java' WHEN ext = '.py' THEN 'python' ELSE 'unknown' END"
)
_COMPLEXITY = "CAST(1 + " + " + ".join(
    f"len(regexp_extract_all(content, '{p}'))"
    for p in (
        r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bswitch\s*\(", r"\bcatch\s*\(", "&&", r"\|\|", r"\?",
    )
) + " AS INTEGER)"
_LINES = "CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER)"
_LINT = _view("lint", V.LINT, "lineitem") + (
    ",\nlinted AS (SELECT doc_id, count(*) FILTER (severity = 2) AS errors, count(*) FILTER (severity = 1) AS warnings, "
    "count(*) AS issues FROM lint GROUP BY doc_id)"
)
_METRICS = (
    _CODE + ",\n" + _LINT + f""",
measured AS (SELECT *, {_EXT.format(p='file_path')} AS ext, {_LANGUAGE} AS language,
  language IN ('javascript', 'typescript') AS is_measured FROM code),
file_metrics AS (SELECT doc_id, repo, file_path, language,
  CASE WHEN is_measured THEN {_COMPLEXITY} ELSE 0 END AS cyclomatic_complexity, {_LINES} AS line_count,
  CASE WHEN is_measured THEN coalesce(issues, 0) ELSE 0 END AS issues,
  CASE WHEN is_measured THEN coalesce(errors, 0) ELSE 0 END AS errors,
  CASE WHEN is_measured THEN coalesce(warnings, 0) ELSE 0 END AS warnings
  FROM measured LEFT JOIN linted USING (doc_id))
"""
)
_SQL["language_mix"] = _with(_CODE) + (
    f"SELECT ext, {_LANGUAGE} AS language, count(*) AS files "
    f"FROM (SELECT {_EXT.format(p='file_path')} AS ext FROM code) GROUP BY ALL"
)
_SQL["cyclomatic"] = _with(_CODE) + f"SELECT doc_id, {_COMPLEXITY} AS complexity FROM code"
_SQL["line_counts"] = _with(_CODE) + f"SELECT doc_id, {_LINES} AS lines FROM code"
_SQL["file_metrics"] = _with(_METRICS) + "SELECT * FROM file_metrics"
_SUMS = (
    "CAST(sum(issues) AS BIGINT) AS issues, CAST(sum(errors) AS BIGINT) AS errors, "
    "CAST(sum(warnings) AS BIGINT) AS warnings, count(*) AS files_analyzed"
)
_SQL["metrics_rollup"] = _with(_METRICS) + f"SELECT repo, {_SUMS} FROM file_metrics GROUP BY repo"
_SQL["metrics_document"] = _with(_METRICS) + f""",
numbered AS (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY file_path) - 1) // 50000 AS page
  FROM file_metrics),
totals AS (SELECT repo, {_SUMS} FROM file_metrics GROUP BY repo),
grouped AS (SELECT repo, page, list({{'file_path': file_path, 'language': language, 'issues': issues,
  'cyclomatic_complexity': cyclomatic_complexity, 'line_count': line_count, 'errors': errors, 'warnings': warnings}}
  ORDER BY file_path) AS files FROM numbered GROUP BY repo, page)
SELECT repo AS job_id, page, CAST(to_json({{'file_metrics': files, 'counts': {{'issues': issues,
  'errors': errors, 'warnings': warnings, 'files_analyzed': files_analyzed}}}}) AS VARCHAR) AS static_metrics FROM grouped JOIN totals USING (repo)"""
_SQL["lint_rollup"] = _with(_CODE, _LINT) + (
    "SELECT doc_id, coalesce(issues, 0) AS issues, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings "
    "FROM code LEFT JOIN linted USING (doc_id)"
)
_SQL["changed_files"] = _with(_CODE) + """,
base AS (SELECT repo, CASE WHEN doc_id % 10 = 0 THEN file_path || '.old' ELSE file_path END AS file_path, content
  FROM code),
head AS (SELECT repo, CASE WHEN doc_id % 11 = 0 THEN file_path || '.new' ELSE file_path END AS file_path,
  CASE WHEN doc_id % 3 = 0 THEN content || chr(10) ELSE content END AS content FROM code)
SELECT repo, file_path, CASE WHEN b.content IS NULL THEN 'added' WHEN h.content IS NULL THEN 'deleted'
  ELSE 'modified' END AS change FROM base b FULL JOIN head h USING (repo, file_path)
WHERE b.content IS DISTINCT FROM h.content"""
_SQL["code_files"] = _with(_view("tree", {"doc_id": "doc_id", "file_path": V.TREE_PATH}, "documents")) + (
    "SELECT doc_id, file_path FROM tree WHERE NOT regexp_matches(file_path, '(^|/)(\\.[^/]*|node_modules)(/|$)') "
    f"AND {_EXT.format(p='file_path')} IN ('.js', '.jsx', '.ts', '.tsx', '.java', '.py')"
)

# Diffs

_FILES = _view("files", V.PR_FILES, "conversations")
_OPEN = "'diff --git a/' || filename || ' b/' || filename"
_PRS = _FILES + (
    f",\nprs AS (SELECT repo, pr_number, string_agg({_OPEN} || chr(10) || content, chr(10) ORDER BY seq) AS diff "
    "FROM files GROUP BY repo, pr_number)"
)
_REBUILT = _with(_PRS) + f""",
parts AS (SELECT repo, pr_number, seq, CASE
    WHEN coalesce(patch, '') <> '' THEN {_OPEN} || chr(10) ||
      CASE WHEN status = 'added' THEN 'new file mode 100644' || chr(10) ELSE '' END || patch
    WHEN status IN ('added', 'renamed') THEN concat_ws(chr(10), {_OPEN}, 'new file mode 100644',
      'index 0000000..' || substring(head_sha, 1, 7), '--- /dev/null', '+++ b/' || filename,
      '+' || replace(content, chr(10), chr(10) || '+'))
    WHEN status = 'modified' THEN {_OPEN} || chr(10) || content END AS part
  FROM files WHERE status <> 'removed' AND NOT is_binary),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY repo, pr_number ORDER BY seq) - 1) // 2000 AS page
  FROM parts WHERE part IS NOT NULL),
rebuilt AS (SELECT repo, pr_number, page, string_agg(part, chr(10) ORDER BY seq) AS diff FROM numbered
  GROUP BY repo, pr_number, page)
SELECT p.repo, p.pr_number, coalesce(r.page, 0) AS page, coalesce(r.diff, p.diff) AS diff, r.diff IS NOT NULL AS rebuilt
FROM prs p LEFT JOIN rebuilt r USING (repo, pr_number)"""
_SQL["rebuild_diff"] = _REBUILT
_SQL["rebuild_diff_contains"] = _REBUILT
_SQL["resolved_diffs"] = _REBUILT.replace(
    "coalesce(r.diff, p.diff) AS diff",
    "CASE WHEN p.pr_number % 3 = 0 THEN coalesce(r.diff, 'Binary files a/x and b/x differ' || chr(10) || p.diff) "
    "ELSE p.diff END AS diff",
).replace("r.diff IS NOT NULL AS rebuilt", "r.diff IS NOT NULL AND p.pr_number % 3 = 0 AS rebuilt")
_SQL["split_diff"] = _with(_FILES) + (
    "SELECT repo, pr_number, CAST(row_number() OVER (PARTITION BY repo, pr_number ORDER BY seq) AS INTEGER) AS segment, "
    f"filename AS path, {_OPEN} || chr(10) || content AS text FROM files"
)
_SQL["diff_sections_by_splits"] = _with(_FILES) + (
    f"SELECT repo, filename AS path, rtrim({_OPEN} || chr(10) || content, chr(10)) AS text FROM files"
)
_SQL["diff_stats"] = _with(_PRS) + (
    "SELECT repo, pr_number, "
    "length(diff) + length(regexp_replace(diff, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS diff_length, "
    "len(regexp_extract_all(chr(10) || diff, '\\n\\+')) - len(regexp_extract_all(chr(10) || diff, '\\n\\+\\+\\+ ')) "
    "AS added_lines, files FROM prs JOIN (SELECT repo, pr_number, count(*) AS files FROM files GROUP BY ALL) "
    "USING (repo, pr_number)"
)
_SQL["diff_paths"] = _with(_FILES) + (
    "SELECT repo, pr_number, string_agg(filename, ';' ORDER BY seq) AS paths FROM files GROUP BY repo, pr_number"
)
_SQL["reviewable_files"] = _with(_FILES) + (
    "SELECT repo, pr_number, seq, filename, status FROM files WHERE status <> 'removed' AND NOT is_binary"
)
_SQL["with_contents"] = _with(_FILES) + (
    "SELECT repo, pr_number, seq, md5(content) AS content_md5 FROM files "
    "WHERE status IN ('added', 'renamed') AND coalesce(patch, '') = ''"
)
_SQL["binary_markers"] = _with(_view("marked", V.MARKED, "documents")) + (
    "SELECT doc_id, regexp_matches(diff, 'Binary files .* differ') AS binary FROM marked"
)
_SQL["prompts"] = (
    f"SELECT doc_id, md5({_text(PROMPT_BEFORE)} || text || {_text(PROMPT_AFTER)}) AS prompt_md5, "
    "substring(text, 1, 200) AS preview FROM documents"
)

# Telemetry, artifacts, scoring

_LATENCY = _view("latency", {"ts": "ts", **V.LATENCY}, "events")
_BUCKETS = ", ".join(f"('{b}', {b})" for b in LATENCY_BOUNDS_MS) + ", ('+Inf', NULL)"


def _histogram(by: str, group: str) -> str:
    head = f"{by} AS {group}, " if by else ""
    first = f"{group}, " if group else ""
    return _with(_LATENCY) + (
        f"SELECT {head}le, count(*) FILTER (bound IS NULL OR latency_ms <= bound) AS bucket_count, "
        "CAST(sum(latency_ms) AS BIGINT) AS latency_sum, count(*) AS latency_count "
        f"FROM latency, (VALUES {_BUCKETS}) b(le, bound) GROUP BY {first}le"
    )


_SQL["latency_histogram"] = _histogram("status", "status")
_SQL["latency_histogram_total"] = _histogram("", "")
_SQL["reviews_total"] = (
    "SELECT CASE WHEN user_id % 2 = 0 THEN 'orchestrator' ELSE 'scorer' END AS service, "
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, count(*) AS reviews_total "
    "FROM events GROUP BY ALL"
)
_ARTIFACT = (
    "'uml/' || CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || "
    "substring(md5('s' || o_orderkey), 1, 8) ELSE md5(CAST(o_orderkey AS VARCHAR(20))) END || '.puml'"
)
_SQL["artifacts"] = (
    "SELECT CASE WHEN o_orderkey % 3 <> 0 THEN md5(CAST(o_orderkey AS VARCHAR(20))) END AS job_id, "
    f"{_ARTIFACT} AS key, CASE WHEN o_orderkey % 5 = 0 THEN {_text(EMPTY_DIAGRAM)} "
    f"ELSE '@startuml ' || o_orderkey END AS body, 'http://localhost:4566/diagrams/' || {_ARTIFACT} AS url FROM orders"
)
_SQL["repo_urls"] = (
    "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'https://github.com/org/a.git' "
    "WHEN 1 THEN 'https://host/org/a' WHEN 2 THEN 'git@host:org/a' "
    "ELSE 'https://github.com/http' || o_orderkey || '.git' END AS url, "
    "substring(md5(CAST(o_orderkey AS VARCHAR(20))), 1, 8) AS sha FROM orders"
)
_SQL["score_diffs"] = (
    "SELECT doc_id, CAST(80 AS INTEGER) AS quality_score, CAST(1 AS BIGINT) AS n_findings, 'default' AS scorer, "
    "'success' AS outcome, 'model' AS source FROM documents"
)
_SQL["score_diffs_custom"] = (
    f"WITH asked AS (SELECT doc_id, length({_text(PROMPT_BEFORE)} || text || {_text(PROMPT_AFTER)}) AS n FROM documents) "
    "SELECT doc_id, CASE WHEN n % 13 <> 0 THEN '{\"quality_score\": ' || (n % 101) || ', \"findings\": []}' END AS raw, "
    "CASE WHEN n % 13 <> 0 THEN 'success' ELSE 'error' END AS outcome FROM asked"
)

_SQL["scored_reviews"] = (
    f"WITH asked AS (SELECT doc_id, length({_text(PROMPT_BEFORE)} || text || {_text(PROMPT_AFTER)}) AS n FROM documents) "
    "SELECT doc_id, CAST(CASE WHEN n % 13 <> 0 THEN n % 101 ELSE 85 END AS INTEGER) AS quality_score, "
    "CAST(CASE WHEN n % 13 <> 0 THEN 0 ELSE 3 END AS BIGINT) AS n_findings, "
    "CASE WHEN n % 13 <> 0 THEN 'model' ELSE 'fallback' END AS source FROM asked"
)
_SQL["upsert_repeated"] = _with(REVIEWS) + (
    ", changes AS (SELECT md5(CAST(CAST(floor(event_id / 3) AS BIGINT) * 2 AS VARCHAR(20))) AS job_id, "
    "arg_max(event_id % 101, event_id) AS score FROM events GROUP BY 1) "
    "SELECT id, CAST(coalesce(score, quality_score) AS BIGINT) AS quality_score FROM reviews LEFT JOIN changes USING (job_id)"
)
_SQL["run_repeated"] = _SQL["run_reviews"]

# Streams

_FETCHED = "coalesce(inline_diff, CASE WHEN event_id % 3 = 1 THEN 'fetched ' || head_sha END)"
_SQL["stream_requests"] = _with(_DELIVERIES) + "SELECT " + _MESSAGE.format(diff=_FETCHED) + f" AND {_FETCHED} IS NOT NULL"
_SQL["stream_no_diff"] = _with(_DELIVERIES) + (
    f"SELECT event_id, head_sha, 500 AS status_code FROM classified WHERE outcome = 'accepted' AND {_FETCHED} IS NULL"
)
_SQL["stream_static_log"] = _SQL["apply_static"]
_SQL["stream_counters"] = (
    f"SELECT strftime(date_trunc('day', ts), {DAY}) AS window_start, event_type AS status, count(*) AS reviews_total "
    "FROM events GROUP BY ALL"
)
_SQL["stream_histogram"] = _histogram(f"strftime(date_trunc('day', ts), {DAY})", "window_start")
_SQL["stream_dedup"] = "SELECT md5(CAST(event_id AS VARCHAR(20))) AS job_id, event_id FROM events"
_SQL["stream_static_join"] = (
    "SELECT md5(CAST(o.event_id AS VARCHAR(20))) AS job_id, CAST(r.event_id AS VARCHAR) AS static_metrics "
    "FROM events o JOIN events r ON o.event_id = r.event_id * 2 "
    "AND r.ts BETWEEN o.ts - INTERVAL 2 DAY AND o.ts + INTERVAL 2 DAY"
)
_SQL["stream_review_state"] = _STATE
_SQL["stream_quarantine"] = _SQL["quarantine"]
_SQL["stream_counters_corrected"] = _SQL["stream_counters"]
_SQL["stream_histogram_corrected"] = _SQL["stream_histogram"]
_SQL["stream_jobs_corrected"] = "SELECT DISTINCT md5(CAST(CAST(floor(event_id / 3) AS bigint) AS VARCHAR(20))) AS job_id FROM events"
_SQL["stream_state_machine"] = _STATE
_HOUR = 3_600_000
_SQL["stream_static_outer"] = (
    f"WITH o AS (SELECT md5(CAST(event_id AS VARCHAR(20))) AS job_id, (epoch_ms(ts) - 12 * {_HOUR}) // {_HOUR} AS first_hour, "
    f"(epoch_ms(ts) + 13 * {_HOUR} - 1) // {_HOUR} AS last_hour FROM events), "
    f"r AS (SELECT {V.RESULT_JOB} AS job_id, event_id, epoch_ms(ts) // {_HOUR} AS hour FROM events) "
    "SELECT o.job_id, CAST(max(r.event_id) AS VARCHAR) AS static_metrics FROM o LEFT JOIN r "
    "ON o.job_id = r.job_id AND r.hour >= o.first_hour AND r.hour < o.last_hour GROUP BY o.job_id"
)
_SQL["surrogate_keys"] = (
    f"SELECT {V.REVIEWS['job_id']} AS job_id, row_number() OVER (ORDER BY greatest(o_orderkey % 4, 1), "
    f"{V.REVIEWS['job_id']}) AS id FROM orders"
)
_SQL["stored_review_detail"] = _with(_view("reviews", V.REVIEW_RECORD, "orders"), FINDINGS) + f""",
numbered AS (SELECT *, (row_number() OVER (PARTITION BY review_id ORDER BY {RANK} DESC, created_at DESC, {ORDER}) - 1)
    // 50000 AS page FROM findings),
nested AS (SELECT review_id, page, count(*) AS n,
    string_agg(concat_ws('|', CAST(review_id * 10 + l_linenumber AS VARCHAR), type, severity, message), ';'
    ORDER BY {RANK} DESC, created_at DESC, {ORDER}) AS listed FROM numbered GROUP BY review_id, page)
SELECT id, job_id, status, quality_score, {_uml('static_metrics')} AS uml_s3_url, strftime(created_at, {DAY}) AS created_at,
  strftime(completed_at, {DAY}) AS completed_at, coalesce(page, 0) AS page, coalesce(n, 0) AS n_findings,
  coalesce(listed, '') AS findings
FROM reviews LEFT JOIN nested ON id = review_id"""
_SQL["stored_attach"] = _SQL["attach_review_id"]
_SQL["stored_cascade"] = _SQL["delete_cascade_findings"]
_SQL["changed_files_by_digest"] = (
    _SQL["changed_files"]
    .replace("CASE WHEN doc_id", f"CASE WHEN regexp_matches(repo, '{V.TOUCHED}') AND doc_id")
)
_SQL["score_diffs_stored"] = _SQL["score_diffs_custom"]
_CHANGED = (
    f", changes AS (SELECT {V.SCORE_CHANGES['job_id']} AS job_id, {V.SCORE_CHANGES['quality_score']} AS score, "
    "row_number() OVER (PARTITION BY floor(event_id / 3) ORDER BY event_id DESC) AS n FROM events), "
    "changed AS (SELECT r.* REPLACE (CASE WHEN c.job_id IS NULL THEN quality_score ELSE score END AS quality_score) "
    "FROM reviews r LEFT JOIN changes c ON c.job_id = r.job_id AND n = 1) "
)
_SQL["quality_trend_updated"] = _SQL["quality_trend"].replace("FROM reviews WHERE", "FROM changed WHERE").replace(
    "SELECT repo, strftime", _CHANGED + "SELECT repo, strftime"
)

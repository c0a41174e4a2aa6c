"""Model responses: read, repair and turn into reviews and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.fixed import CANNED_RESPONSE, DEFAULT_DIAGRAM, DEFAULT_SCORE, EMPTY_DIAGRAM, UNREACHABLE_RESPONSE
from diffmill.functions.json import (
    LINE_TEXT,
    field,
    is_object,
    kind_of,
    once,
    score_clamp,
    score_strict,
    with_json,
)
from diffmill.functions.normalize import null_if_falsy, normalize_severity, normalize_type
from diffmill.operators.reviews import assign_ids
from diffmill.schemas import FINDING, REVIEWS

# JSON values that count as "not given" for a type or severity.
FALSY_JSON = ("null", '""', "0", "0.0", "false", "[]", "{}")

# fenced: a fenced block is looked for, scores are cut to range.
# plain: the text must be JSON as it stands, scores must be in range.
MODES = ("fenced", "plain")


def parse_response(df: DataFrame, raw: str = "raw", mode: str = "fenced", name: str = "doc") -> DataFrame:
    """Add the variant of a raw response (G10). Nothing at all reads as an empty object;
    what cannot be read does too in ``fenced`` mode and is NULL in ``plain`` mode."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    text = F.coalesce(F.nullif(F.col(raw), F.lit("")), F.lit("{}"))
    parsed = with_json(df, "_first", text)
    if mode == "plain":
        return parsed.withColumnRenamed("_first", name)
    inside = F.trim(F.regexp_extract(raw, "(?s)```json(.*?)```", 1))
    again = with_json(parsed, "_second", F.when(F.col("_first").isNull(), inside))
    doc = F.coalesce("_first", "_second", F.parse_json(F.lit("{}")))
    return again.withColumn(name, doc).drop("_first", "_second")


def canned(response: dict) -> Column:
    """A fixed response as a literal: score, findings, plantuml."""
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            *[F.lit(f[n.name]).cast(n.dataType).alias(n.name) for n in FINDING.fields[1:]],
        )
        for i, f in enumerate(response["findings"])
    ]
    return F.struct(
        F.lit(response["quality_score"]).alias("quality_score"),
        F.array(*rows).cast(_findings_type()).alias("findings"),
        F.lit(response["plantuml"]).alias("plantuml"),
    )


def _findings_type() -> str:
    return f"array<{FINDING.simpleString()}>"


# Fields of a finding as they came, NULL where missing.
_RAW_FINDING = "struct<" + ",".join(f"{f.name}:variant" for f in FINDING.fields[1:]) + ">"


def _fields(item: Column) -> Column:
    """The raw fields of an element; NULL for one that is no object."""
    return F.try_variant_get(item, "$", _RAW_FINDING)


def _read(given: Column) -> Column:
    """Kind, text and raw value of every field."""
    parts = []
    for f in FINDING.fields[1:]:
        raw = given[f.name]
        parts += [
            F.schema_of_variant(raw).alias(f"{f.name}_kind"),
            F.try_variant_get(raw, "$", "string").alias(f.name),
            raw.alias(f"{f.name}_raw"),
        ]
    return F.when(given.isNotNull(), F.struct(*parts))


def _is_text(read: Column, name: str) -> Column:
    kind = read[f"{name}_kind"]
    return kind.isNull() | kind.isin("VOID", "STRING")


def _is_label(read: Column, name: str) -> Column:
    """Text, or a value that counts as not given."""
    return _is_text(read, name) | F.to_json(read[f"{name}_raw"]).isin(*FALSY_JSON)


def _is_line(read: Column) -> Column:
    kind, number = read["line_number_kind"], F.try_variant_get(read["line_number_raw"], "$", "double")
    return (
        kind.isNull()
        | kind.isin("VOID", "BIGINT", "BOOLEAN")
        | ((kind == "STRING") & read["line_number"].rlike(LINE_TEXT))
        | ((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (number == F.floor(number)))
    )


def _line_number(read: Column) -> Column:
    digits = F.regexp_replace(F.trim(F.regexp_replace(read["line_number"], r"\.0+\s*$", "")), "_", "")
    return F.when(read["line_number_kind"] == "STRING", digits.try_cast("int")).otherwise(
        F.try_variant_get(read["line_number_raw"], "$", "int")
    )


def _typed(read: Column, ordinal: Column) -> Column:
    """A finding with typed fields, its type and severity normalized once; NULL if any
    field breaks the schema (G12)."""
    message = read["message_kind"]
    fits = (
        read.isNotNull()
        & (message.isNull() | (message == "STRING"))
        & _is_text(read, "file_path")
        & _is_text(read, "suggestion")
        & _is_label(read, "type")
        & _is_label(read, "severity")
        & _is_line(read)
    )
    finding = F.struct(
        ordinal.cast("int").alias("ordinal"),
        normalize_type(read["type"]).alias("type"),
        normalize_severity(read["severity"]).alias("severity"),
        read["file_path"].alias("file_path"),
        _line_number(read).alias("line_number"),
        F.coalesce(read["message"], F.lit("")).alias("message"),
        read["suggestion"].alias("suggestion"),
    )
    return F.when(fits, finding)


def review_responses(df: DataFrame, raw: str = "raw", mode: str = "fenced", bad: str = "strict") -> DataFrame:
    """Score, findings, diagram and source of each raw response.

    ``source`` tells how it came about: ``model``; ``canned`` for an answer that is no
    usable object; ``void`` where an element broke the schema and took the whole
    response with it (score 80, no findings); NULL for a call that failed (NULL raw),
    which has no answer at all (see ``with_fallback``). With ``bad='lenient'`` a broken
    element drops out alone. The array is checked in place; nothing is shuffled.
    """
    if bad not in ("strict", "lenient"):
        raise ValueError("bad is 'strict' or 'lenient'")
    doc, listed = F.col("_doc"), F.col("_elements").isNotNull()
    unusable, odd_list = ~is_object(doc), F.lit(False)
    if mode == "plain":
        kind = kind_of(doc, "findings")
        filled = ~F.to_json(field(doc, "findings")).isin('""', "{}")
        unusable = unusable | (~listed & kind.isNotNull() & ~kind.startswith("OBJECT") & (kind != "STRING"))
        odd_list = ~listed & kind.isNotNull() & filled
    broken = F.exists("_items", lambda f: f.isNull()) if bad == "strict" else F.lit(False)
    odd_diagram = kind_of(doc, "plantuml") != "STRING"
    void = F.coalesce(odd_list | broken | F.coalesce(odd_diagram, F.lit(False)), F.lit(False))
    score = score_clamp(doc) if mode == "fenced" else score_strict(doc)
    none = F.array().cast(_findings_type())
    answer = F.struct(
        score.alias("quality_score"),
        F.coalesce(F.filter("_items", lambda f: f.isNotNull()).cast(_findings_type()), none).alias("findings"),
        F.coalesce(field(doc, "plantuml", "string"), F.lit(DEFAULT_DIAGRAM)).alias("plantuml"),
    )
    safe = F.struct(
        F.lit(DEFAULT_SCORE).alias("quality_score"), none.alias("findings"), F.lit(EMPTY_DIAGRAM).alias("plantuml")
    )
    chosen = (
        F.when(F.col("source").isNull(), F.lit(None))
        .when(F.col("source") == "canned", canned(CANNED_RESPONSE))
        .when(F.col("source") == "void", safe)
        .otherwise(answer)
    )
    answered = F.when(F.coalesce(unusable, F.lit(True)), "canned").when(void, "void").otherwise("model")
    answered = F.when(F.col(raw).isNotNull(), answered)
    read = (
        parse_response(df, raw, mode, "_doc")
        .withColumn("_elements", F.try_variant_get(doc, "$.findings", "array<variant>"))
        .withColumn("_items", F.transform(F.transform(F.transform("_elements", _fields), _read), _typed))
        .withColumn("source", answered)
    )
    return once(read, _answer=chosen).select(*df.columns, "_answer.*", "source")


def with_fallback(df: DataFrame, default: dict = UNREACHABLE_RESPONSE, source: str = "fallback") -> DataFrame:
    """Fill rows that have no response (NULL ``source``) with a fixed one."""
    absent = F.col("source").isNull()
    filled = canned(default)
    names = ("quality_score", "findings", "plantuml")
    columns = {n: F.when(absent, filled[n]).otherwise(F.col(n)) for n in names}
    return df.withColumns({**columns, "source": F.coalesce("source", F.lit(source))})


def explode_findings(responses: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding with its ``ordinal``."""
    return responses.select(*keys, F.explode("findings").alias("_f")).select(*keys, "_f.*")


def stored_findings(findings: DataFrame, at: Column, keys: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """Findings rows as they are stored: normalized again, empty values to NULL. The id
    follows from ``keys`` and the ordinal; keys beyond the review id are carried along."""
    return assign_ids(findings, [*keys, "ordinal"]).select(
        *[k for k in keys if k != "review_id"],
        "id",
        "review_id",
        "ordinal",
        normalize_type(F.col("type")).alias("type"),
        normalize_severity(F.col("severity")).alias("severity"),
        null_if_falsy(F.col("file_path")).alias("file_path"),
        null_if_falsy(F.col("line_number"), numeric=True).alias("line_number"),
        "message",
        null_if_falsy(F.col("suggestion")).alias("suggestion"),
        at.alias("created_at"),
    )


@dataclass(frozen=True)
class Run:
    """Outputs of a review run. ``shown`` are the once-normalized findings, which the
    comment uses; ``findings`` are the stored ones. Both carry ``job_id``, the key to
    join on; the 64-bit ids are for display."""

    joined: DataFrame
    reviews: DataFrame
    findings: DataFrame
    shown: DataFrame
    events: DataFrame


def join_responses(
    requests: DataFrame, responses: DataFrame, order: list[str] | None = None, bulk: tuple[str, ...] = ("diff",)
) -> DataFrame:
    """Requests with their response; without one, the fallback of an unreachable service.

    Both may arrive again and again. Equal requests count once, where the ``bulk`` columns
    go with the others and are not compared: what does not read them later does not move
    them either. Of several responses to
    a job the last by ``order`` holds (without one: the best scored), and one that came
    to nothing (NULL ``source``) only if there is no other.
    """
    names = ("quality_score", "findings", "plantuml", "source")
    last = F.max_by(F.struct(*names), F.struct(F.col("source").isNotNull(), *(order or ["quality_score"])))
    answered = responses.groupBy("job_id").agg(last.alias("_last")).select("job_id", "_last.*")
    asked = requests.dropDuplicates([c for c in requests.columns if c not in bulk])
    return with_fallback(asked.join(answered, "job_id", "left"))


def run_reviews(joined: DataFrame, at: Column) -> Run:
    """Reviews, findings and outcome events of requests joined to responses.

    Write ``joined`` to a table first when it is costly: the outputs read it again. A
    finding whose type or severity is NULL fails its review, which then stores no
    findings and no score.
    """
    failing = F.exists("findings", lambda f: f["type"].isNull() | f["severity"].isNull())
    state = joined.withColumn("_status", F.when(failing, "failed").otherwise("done"))
    done = F.col("_status") == "done"
    reviews = (
        assign_ids(state, ["job_id"])
        .withColumns({
            "status": F.col("_status"),
            "quality_score": F.when(done, F.col("quality_score")),
            "static_metrics": F.lit(None).cast("string"),
            "github_comment_id": F.lit(None).cast("string"),
            "created_at": at,
            "completed_at": F.when(done, at),
        })
        .select(REVIEWS.fieldNames())
    )
    keyed = assign_ids(state.where(done), ["job_id"], "review_id")
    shown = explode_findings(keyed, ["job_id", "review_id"])
    events = state.select(
        F.lit("orchestrator").alias("service"), "job_id", F.col("_status").alias("status"), at.alias("ts")
    )
    return Run(joined, reviews, stored_findings(shown, at, ("job_id", "review_id")), shown, events)

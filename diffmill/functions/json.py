"""JSON reading that keeps the types a model or a caller really sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.fixed import DEFAULT_SCORE

# Integer texts that both scores and line numbers accept.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
LINE_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*(\.0+)?\s*$"


def framed_json(raw: Column) -> Column:
    """Variant of ``[raw, 0]``, NULL if that is no JSON.

    ``try_parse_json`` stops after the first value and would accept ``{} x``. Inside an
    array with a closing element, anything left over shows.
    """
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(",0]")))


def framed_value(framed: Column) -> Column:
    """The value inside the frame, NULL unless it is exactly one."""
    one = F.try_variant_get(framed, "$[1]", "int").eqNullSafe(0)
    more = F.try_variant_get(framed, "$[2]", "variant").isNotNull()
    return F.when(one & ~more, F.try_variant_get(framed, "$[0]", "variant"))


def strict_json(raw: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else NULL."""
    return framed_value(framed_json(raw))


def with_json(df: DataFrame, name: str, raw: Column) -> DataFrame:
    """Add ``strict_json(raw)``, parsed once per row however often it is used later."""
    return once(df.withColumn("_framed", framed_json(raw)), **{name: framed_value(F.col("_framed"))}).drop("_framed")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters must not compute again.

    A filter on a plain column is moved below it and repeats its whole expression for
    every mention. Expressions are not copied through a generator, so the columns come
    out of one over a single-element array.
    """
    entry = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(entry)))


def field(doc: Column, name: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(doc, f"$.{name}", as_type)


def kind_of(doc: Column, name: str | None = None) -> Column:
    """BIGINT, STRING, VOID, ...; NULL where the field is missing."""
    return F.schema_of_variant(doc if name is None else field(doc, name))


def is_object(doc: Column) -> Column:
    """Whether the value is an object. Reading it as one is cheaper than its schema."""
    return F.try_variant_get(doc, "$", "struct<_:variant>").isNotNull()


def is_array(doc: Column) -> Column:
    return F.try_variant_get(doc, "$", "array<variant>").isNotNull()


def text_field(doc: Column, name: str) -> Column:
    """The field if it is a JSON string, else NULL."""
    return F.when(kind_of(doc, name) == "STRING", field(doc, name, "string"))


def score_strict(doc: Column) -> Column:
    """A JSON integer or boolean in 0..100, else 80."""
    kind, n = kind_of(doc, "quality_score"), field(doc, "quality_score", "bigint")
    fits = kind.isin("BIGINT", "BOOLEAN") & n.between(0, 100)
    return F.when(fits, n).otherwise(DEFAULT_SCORE).cast("int")


def score_clamp(doc: Column) -> Column:
    """Anything that reads as an integer, cut to 0..100, else 80."""
    kind = kind_of(doc, "quality_score")
    text = field(doc, "quality_score", "string")
    digits = F.regexp_replace(F.trim(text), "_", "")
    number = (
        F.when((kind == "STRING") & text.rlike(INTEGER_TEXT), digits.try_cast("double"))
        .when(kind.isin("BIGINT", "BOOLEAN", "DOUBLE") | kind.startswith("DECIMAL"), field(doc, "quality_score", "double"))
    )
    near = F.greatest(F.lit(-1.0), F.least(F.lit(101.0), number)).cast("int")
    cut = F.greatest(F.lit(0), F.least(F.lit(100), near))
    return F.when(number.isNull(), DEFAULT_SCORE).otherwise(cut).cast("int")


def uml_url(static_metrics: Column) -> Column:
    """Diagram address inside the metrics text; NULL if absent, empty or bad JSON."""
    url = field(strict_json(static_metrics), "uml_s3_url", "string")
    return F.nullif(url, F.lit(""))

"""Model responses and uploads to typed values, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alternatives


def json_object(raw: Column) -> Column:
    """The response's JSON object as VARIANT: of a fenced block, or from the first { to the last }; else null."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    found = F.try_parse_json(F.when(fenced != "", fenced).otherwise(braced))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def confidence(value: Column) -> Column:
    """A number or numeric string; above 1 a percentage; held in 0..1; anything else null."""
    number = value.try_cast("double")
    number = F.when(F.isnan(number), None).otherwise(number)
    scaled = F.when(number > 1, number / 100).otherwise(number)
    return F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def scalar_answer(found: Column) -> Column:
    """value as text; empty is null."""
    return F.nullif(F.trim(F.try_variant_get(found, "$.value", "string")), F.lit(""))


def list_answer(found: Column) -> Column:
    """values as a list without blanks; null (an error) if it is no list."""
    listed = F.try_variant_get(found, "$.values", "array<string>")
    return F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")


def screening_decision(found: Column) -> Column:
    word = F.upper(F.trim(F.try_variant_get(found, "$.decision", "string")))
    return F.when(word.isin("INCLUDE", "EXCLUDE", "MAYBE"), word).otherwise("MAYBE")


def uploaded_value(value: Column) -> Column:
    """An upload's cell as JSON: a list where a pipe divides it, else a string."""
    return F.when(value.contains("|"), F.to_json(alternatives(value))).otherwise(F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6))


def curator_cell(value: Column) -> Column:
    """A curator's cell as a list of alternatives; blank is the empty list."""
    return alternatives(value)


def target_json(value: Column, confident: Column) -> Column:
    """The assistant's side of a training example, null fields kept."""
    return F.to_json(F.struct(value.alias("value"), confident.alias("confidence")), {"ignoreNullFields": "false"})


def mean_probability(logprobs: Column) -> Column:
    """exp of the mean of the log-probabilities that are there; null if none is."""
    known = F.filter(logprobs, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, F.exp(total / F.size(known)))

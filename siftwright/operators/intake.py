"""Model responses in, typed hypotheses out. Responses come as a table (dataset, response)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright import schemas

# Keys that a hypothesis and its test plan must carry, in sorted order.
REQUIRED_KEYS = [
    "claim", "direction", "id", "relationship_type", "risk_flags",
    "supporting_evidence", "test_plan", "variables",
]
PLAN_KEYS = ["alpha", "multiple_testing", "null_hypothesis", "primary_test"]
NOT_JSON = "ValueError: Model output is not valid JSON."


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _is_list(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


def _plain_json(text: str | None) -> str | None:
    try:
        # the last value of a repeated key stays; numbers that JSON cannot hold become null
        value = json.loads(text, parse_constant=lambda _: None) if text else None
        return json.dumps(value) if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _lenient(texts: pd.Series) -> pd.Series:
    return texts.map(_plain_json)


def _read(text: Column) -> Column:
    """JSON as a variant; what the strict parser refuses (repeated keys, bare NaN) is read leniently."""
    strict = F.try_parse_json(text)
    return F.coalesce(strict, F.try_parse_json(_lenient(F.when(strict.isNull(), text))))


def extract(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add `doc`: the whole text as a JSON object, else the part from the first { to the last }.

    Of repeated keys the last one counts, and a bare NaN or Infinity is read as null.
    """
    trimmed = F.trim(F.col(text))
    start = F.instr(trimmed, "{")
    back = F.instr(F.reverse(trimmed), "}")
    end = F.length(trimmed) - back + 1
    inner = F.when(
        (start > 0) & (back > 0) & (end > start), F.substring(trimmed, start, end - start + 1)
    )
    return (
        responses.withColumn("_whole", _read(trimmed))
        .withColumn("_inner", _read(inner))
        .withColumn(
            "doc",
            F.when(_is_object(F.col("_whole")), F.col("_whole")).when(_is_object(F.col("_inner")), F.col("_inner")),
        )
        .drop("_whole", "_inner")
    )


def _listed(names: Column) -> Column:
    """['a', 'b'] as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _fault(h: Column, number: Column) -> Column:
    """First fault of one hypothesis, NULL if none."""
    name = F.concat(F.lit("ValueError: Hypothesis "), number.cast("string"))
    plan = F.try_variant_get(h, "$.test_plan", "variant")
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), _keys(h))
    missing_plan = F.array_except(F.array(*[F.lit(k) for k in PLAN_KEYS]), _keys(plan))

    def not_list(key: str) -> Column:
        return F.when(
            ~_is_list(F.try_variant_get(h, f"$.{key}", "variant")),
            F.concat(name, F.lit(f" '{key}' must be a list.")),
        )

    return F.coalesce(
        F.when(~_is_object(h), F.concat(name, F.lit(" is not an object."))),
        F.when(F.size(missing) > 0, F.concat(name, F.lit(" missing keys: "), _listed(missing))),
        not_list("variables"), not_list("supporting_evidence"), not_list("risk_flags"),
        F.when(~_is_object(plan), F.concat(name, F.lit(" test_plan must be an object."))),
        F.when(F.size(missing_plan) > 0, F.concat(name, F.lit(" test_plan missing keys: "), _listed(missing_plan))),
    )


def check(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add `items` (raw hypotheses) and `error` (first fault of the response, NULL if it is good)."""
    df = extract(responses, text)
    raw = F.try_variant_get("doc", "$.hypotheses", "variant")
    df = df.withColumn("items", F.when(_is_list(raw), F.try_variant_get("doc", "$.hypotheses", "array<variant>")))
    faults = F.filter(F.transform("items", lambda h, i: _fault(h, i + 1)), lambda x: x.isNotNull())
    return df.withColumn(
        "error",
        F.when(F.col("doc").isNull(), NOT_JSON)
        .when(F.col("items").isNull(), "ValueError: Output must contain a 'hypotheses' list.")
        .otherwise(F.try_element_at(faults, F.lit(1))),
    )


def parse(responses: DataFrame, text: str = "response") -> tuple[DataFrame, DataFrame]:
    """(hypotheses, errors). A response with any fault is rejected whole; its text is kept.

    Hypotheses: dataset, pos and the typed fields. `has_spec` tells whether there is a validation
    spec with content, as that key is not required here.
    """
    checked = check(responses, text)
    errors = checked.filter(F.col("error").isNotNull()).select(
        "dataset", "error", F.col(text).alias("raw_output")
    )
    each = checked.filter(F.col("error").isNull()).select("dataset", F.posexplode("items").alias("pos", "h"))
    return typed(each), errors


def typed(each: DataFrame) -> DataFrame:
    """Hypothesis columns from (dataset, pos, h variant)."""
    spec = F.try_variant_get("h", "$.validation_spec", "variant")
    controls = F.try_variant_get(spec, "$.controls", "variant")
    has_controls = F.coalesce(F.array_contains(_keys(spec), "controls"), F.lit(False))
    return each.select(
        "dataset", "pos", F.from_json(F.to_json("h"), schemas.HYPOTHESIS).alias("t"),
        (_is_object(spec) & (F.size(F.coalesce(_keys(spec), F.array().cast("array<string>"))) > 0)).alias("has_spec"),
        _is_list(F.try_variant_get(spec, "$.predictors", "variant")).alias("predictors_listed"),
        (_is_list(controls) | ~has_controls).alias("controls_listed"),
        F.coalesce(F.to_json(spec), F.lit("{}")).alias("spec_json"),
    ).select("dataset", "pos", "t.*", "has_spec", "predictors_listed", "controls_listed", "spec_json")


def response_metadata(responses: DataFrame, text: str = "response") -> DataFrame:
    """One row per accepted response with its number of hypotheses."""
    ok = check(responses, text).filter(F.col("error").isNull())
    extra = [c for c in ("model", "temperature") if c in responses.columns]
    return ok.select("dataset", *extra, F.size("items").alias("hypothesis_count"))

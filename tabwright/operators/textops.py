"""Per-row text helpers: question routing and JSON recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kinds import col

# Keywords per stage, first match wins in this order.
ROUTES = (
    ("clean", ("clean my", "clean the", "clean data", "run clean", "impute", "remove duplicates", "fix missing")),
    ("feature_engineer", ("run feature", "engineer feature", "encode columns", "scale data", "normalize", "one-hot")),
    ("model_select", ("train model", "run model", "fit model", "run prediction", "train and compare", "best model")),
    ("profile", ("run pipeline", "full pipeline", "run all")),
)
DIRECT = "direct"


def route_of(text: Column) -> Column:
    """The stage that should answer a question."""
    q = F.lower(text)
    out = F.lit(DIRECT)
    for stage, words in reversed(ROUTES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(q, F.lit(w))
        out = F.when(hit, stage).otherwise(out)
    return F.when(text.isNotNull(), out)


def route_questions(df: DataFrame, text_col: str, out: str = "stage") -> DataFrame:
    return df.withColumn(out, route_of(col(text_col)))


def route_counts(df: DataFrame, text_col: str) -> DataFrame:
    return route_questions(df, text_col).groupBy("stage").agg(F.count(F.lit(1)).alias("questions"))


def _as_object(text: Column) -> Column:
    """The text if it is exactly one JSON object, else NULL.

    The parser stops after the first complete value, so the text is checked inside an array and
    inside an object: anything after the first value breaks one of the two.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    nested = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    only = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant")).startswith("OBJECT")
    return F.when(nested.isNotNull() & only, text)


def recover_json(df: DataFrame, text_col: str, out: str = "json") -> DataFrame:
    """Find the JSON object in noisy text.

    The whole text is tried first, then the span from the first ``{`` to the last ``}``. Adds the
    recovered text (NULL when invalid) and a validity flag.
    """
    whole = F.trim(col(text_col))
    span = F.regexp_extract(col(text_col), r"(?s)\{.*\}", 0)
    found = F.coalesce(_as_object(whole), _as_object(F.when(span != "", span)))
    return df.withColumn(out, found).withColumn(f"{out}_valid", F.col(out).isNotNull())


def recover_actions(df: DataFrame, text_col: str) -> DataFrame:
    """Tool name, arguments and summary of an action object; a missing tool means FINISH."""
    recovered = recover_json(df, text_col)
    parsed = F.from_json("json", "action struct<tool:string, arguments:string>, summary string, thinking string")
    return recovered.withColumn("__p", parsed).select(
        *[col(c) for c in df.columns],
        "json_valid",
        F.when(F.col("json_valid"), F.coalesce("__p.action.tool", F.lit("FINISH"))).alias("tool"),
        F.col("__p.action.arguments").alias("arguments"),
        F.when(F.col("json_valid"), F.coalesce("__p.summary", F.lit(""))).alias("summary"),
    )

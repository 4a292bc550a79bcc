"""Model quality as aggregations over (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.kinds import col


def confusion(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*[col(b) for b in by], col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """Accuracy and weighted F1 (a class never predicted scores 0), one row per group.

    Everything after the first aggregation works on classes x classes rows.
    """
    keys = [col(b) for b in by]
    cells = confusion(df, label, prediction, by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").cast("string").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("prediction").cast("string").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )
    per_class = cells.select(*keys, F.inline(sides)).groupBy(*keys, "c").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "tp")])
    f1 = F.col("support") * F.try_divide(F.col("tp") * 2.0, F.col("support") + F.col("predicted"))
    return per_class.groupBy(*keys).agg(
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(f1), F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("rows"),
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """R2 and RMSE in one aggregation, one row per group."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    sums = df.groupBy(*[col(b) for b in by]).agg(
        F.sum((y - p) * (y - p)).alias("res"), (F.var_pop(y) * F.count(y)).alias("tot"), F.count(y).alias("rows")
    )
    r2 = F.when(F.col("tot") > 0, 1.0 - F.col("res") / F.col("tot")).when(F.col("res") == 0, 1.0).otherwise(0.0)
    return sums.select(*[col(b) for b in by], r2.alias("r2"), F.sqrt(F.try_divide(F.col("res"), F.col("rows"))).alias("rmse"), "rows")

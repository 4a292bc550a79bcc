"""Table and column profiles as small tidy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.kinds import (
    CATEGORICAL, DATETIME, NUMERIC, categorical_columns, col, kind_of, numeric_columns, quoted, require_columns,
)
from ..functions.missing import literal_sql, missing_sql, present
from .correlation import correlation_pairs
from .frequencies import freq_table, top_values
from .moments import (
    adjusted_kurtosis, adjusted_skewness, aggregate, base_stats, inline_rows, power_sums, sample_std,
)
from .quantiles import quantiles

REPORT_SCHEMA = "section string, item string, metric string, value double, text string"


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("int").alias("columns"))


def estimated_mb(df: DataFrame) -> float:
    """The optimizer's size estimate of the table in MB, without running a job."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return round(int(str(size)) / 1e6, 2)


def dtype_profile(df: DataFrame) -> DataFrame:
    """Type, kind and number of present values of every column."""
    aggs = [f"count_if(NOT {missing_sql(df, c)}) AS p{i}" for i, c in enumerate(df.columns)]
    structs = [
        f"named_struct('column', {literal_sql(f.name)}, 'dtype', {literal_sql(f.dataType.simpleString())}, "
        f"'kind', {literal_sql(kind_of(f.dataType))}, 'present', p{i})"
        for i, f in enumerate(df.schema.fields)
    ]
    return inline_rows(aggregate(df, aggs), structs)


def kind_counts(df: DataFrame) -> dict[str, int]:
    """Columns per kind, from the schema alone."""
    kinds = [kind_of(f.dataType) for f in df.schema.fields]
    return {k: kinds.count(k) for k in (NUMERIC, CATEGORICAL, DATETIME)}


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """``(rows, missing cells per column)`` on the driver, from one aggregation."""
    aggs = ["count(1) AS rows"] + [f"count_if({missing_sql(df, c)}) AS m{i}" for i, c in enumerate(df.columns)]
    row = aggregate(df, aggs).first()
    return row["rows"], {c: row[f"m{i}"] for i, c in enumerate(df.columns)}


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with missing cells: ``(column, missing_count, missing_pct)``."""
    aggs = ["count(1) AS rows"] + [f"count_if({missing_sql(df, c)}) AS m{i}" for i, c in enumerate(df.columns)]
    structs = [
        f"named_struct('column', {literal_sql(c)}, 'missing_count', m{i}, "
        f"'missing_pct', round(try_divide(m{i} * 100.0D, rows), 2))"
        for i, c in enumerate(df.columns)
    ]
    return inline_rows(aggregate(df, aggs), structs).where("missing_count > 0")


def missing_totals(df: DataFrame) -> DataFrame:
    cells = " + ".join(f"CAST({missing_sql(df, c)} AS INT)" for c in df.columns)
    return aggregate(df, [f"coalesce(sum({cells}), 0L) AS total_missing_cells", f"count(1) * {len(df.columns)} AS total_cells"]).select(
        "total_missing_cells",
        "total_cells",
        F.expr("round(try_divide(total_missing_cells * 100.0D, total_cells), 2)").alias("overall_missing_pct"),
    )


def numeric_stats(df: DataFrame, names: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Mean, median, deviation, extremes, adjusted skewness and kurtosis, share of zeros."""
    names = numeric_columns(df) if names is None else names
    base = base_stats(df, names)
    median = quantiles(df, {n: [0.5] for n in names}, base, exact)
    aggs, structs = ["count(1) AS rows"], []
    for i, n in enumerate(names):
        b = base[n]
        aggs += power_sums(df, n, b, str(i)) + [f"count_if({quoted(n)} = 0) AS z{i}"]
        fields = {
            "mean": literal_sql(b.mean),
            "median": literal_sql(median[n][0]),
            "std": sample_std(f"m2_{i}", b),
            "min": literal_sql(b.low),
            "max": literal_sql(b.high),
            "skewness": adjusted_skewness(f"m2_{i}", f"m3_{i}", b),
            "kurtosis": adjusted_kurtosis(f"m2_{i}", f"m4_{i}", b),
        }
        body = ", ".join(f"'{k}', round(CAST({v} AS DOUBLE), 4)" for k, v in fields.items())
        zeros = f"round(z{i} * 100.0D / {b.n}D, 2)" if b.n else "0.0D"
        structs.append(f"named_struct('column', {literal_sql(n)}, {body}, 'zeros_pct', {zeros})")
    if not structs:
        return df.sparkSession.createDataFrame([], "column string, mean double, median double, std double, min double, max double, skewness double, kurtosis double, zeros_pct double")
    return inline_rows(aggregate(df, aggs), structs)


def categorical_stats(df: DataFrame, names: list[str] | None = None, k: int = 5) -> DataFrame:
    """Distinct count, cardinality, mean length and the k most frequent values of text columns."""
    names = categorical_columns(df) if names is None else names
    freq = freq_table(df, names)
    totals = freq.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.sum("count").alias("present"),
        F.sum(F.char_length("value") * F.col("count")).alias("length"),
    )
    # One row per column, so the schema bounds the broadcast side.
    return top_values(freq, k).join(F.broadcast(totals), "column").select(
        "column",
        "unique_count",
        F.expr("round(unique_count * 100.0D / present, 2)").alias("cardinality_pct"),
        F.expr("round(CAST(length AS DOUBLE) / present, 1)").alias("avg_length"),
        "rank",
        "value",
        "count",
    )


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Second and later copies of whole rows; NULLs (and NaNs) compare equal."""
    return _state_sums(df).selectExpr("duplicates AS duplicate_rows", "round(duplicates * 100.0D / greatest(rows, 1), 2) AS duplicate_pct", "rows AS total_rows")


def _state_sums(df: DataFrame) -> DataFrame:
    """Rows, missing cells and duplicates together, as one row.

    Rows are told apart by 128 bits of hash first, so what is shuffled is 16 bytes and a count for each
    row; only rows whose hash is met twice are grouped as they are, which makes the count exact.
    """
    cells = " + ".join(f"CAST({missing_sql(df, c)} AS INT)" for c in df.columns)
    values = [col(c) for c in df.columns]
    hashes = [F.xxhash64(*values).alias("__h1"), F.xxhash64(F.lit("second"), *values).alias("__h2")]
    seen = df.select(*hashes, F.expr(cells).alias("__cells")).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n"), F.sum("__cells").alias("m"))
    twice = df.select("*", *hashes).join(seen.where("n > 1").select("__h1", "__h2"), ["__h1", "__h2"], "left_semi")
    copies = twice.groupBy(*values).agg(F.count(F.lit(1)).alias("n"))
    parts = seen.agg(F.sum("n").alias("rows"), F.sum("m").alias("missing_total"), F.lit(0).cast("bigint").alias("duplicates")).unionAll(
        copies.agg(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.sum(F.col("n") - 1))
    )
    return aggregate(parts, ["coalesce(sum(rows), 0L) AS rows", "coalesce(sum(missing_total), 0L) AS missing_total", "coalesce(sum(duplicates), 0L) AS duplicates"])


def cleaning_state(df: DataFrame) -> DataFrame:
    k = len(df.columns)
    return _state_sums(df).selectExpr(
        "rows",
        f"{k} AS columns",
        "missing_total",
        f"round(missing_total * 100.0D / greatest(rows * {k}, 1), 2) AS missing_pct",
        "duplicates",
    )


def quality_profile(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness and numeric-column ratio, all 0..100 (0 for an empty table)."""
    k = len(df.columns)
    ratio = 100.0 * len(numeric_columns(df)) / k if k else 0.0
    return _state_sums(df).selectExpr(
        f"round(coalesce((1.0D - try_divide(CAST(missing_total AS DOUBLE), rows * {k})) * 100.0D, 0.0D), 4) AS completeness",
        "round(coalesce((1.0D - try_divide(CAST(duplicates AS DOUBLE), rows)) * 100.0D, 0.0D), 4) AS uniqueness",
        f"round({literal_sql(ratio)}, 4) AS numeric_ratio",
    )


def completeness(df: DataFrame, when_empty: float = 100.0) -> DataFrame:
    """Share of present cells in percent."""
    return missing_totals(df).selectExpr(
        f"coalesce((1.0D - try_divide(CAST(total_missing_cells AS DOUBLE), total_cells)) * 100.0D, {literal_sql(float(when_empty))}) AS completeness"
    )


def load_summary(df: DataFrame) -> DataFrame:
    """What an import shows: rows, columns, missing cells and share, columns per kind."""
    kinds = kind_counts(df)
    return missing_totals(df).selectExpr(
        f"CAST(total_cells / {max(len(df.columns), 1)} AS BIGINT) AS rows",
        f"{len(df.columns)} AS columns",
        "total_missing_cells AS missing_cells",
        "coalesce(round(try_divide(total_missing_cells * 100.0D, total_cells), 1), 0.0D) AS missing_pct",
        *[f"{kinds[k]} AS {k}_columns" for k in kinds],
    )


def describe(df: DataFrame, max_columns: int | None = 6, exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max of the first numeric columns."""
    names = numeric_columns(df)[:max_columns]
    base = base_stats(df, names)
    q = quantiles(df, {n: [0.25, 0.5, 0.75] for n in names}, base, exact)
    aggs, structs = ["count(1) AS rows"], []
    for i, n in enumerate(names):
        b = base[n]
        aggs += power_sums(df, n, b, str(i), powers=(2,))
        values = (b.mean, None, b.low, *q[n], b.high)
        texts = [literal_sql(v) for v in values]
        texts[1] = sample_std(f"m2_{i}", b)
        body = ", ".join(f"'{k}', round(CAST({v} AS DOUBLE), 2)" for k, v in zip(("mean", "std", "min", "q25", "q50", "q75", "max"), texts))
        structs.append(f"named_struct('column', {literal_sql(n)}, 'count', {b.n}L, {body})")
    return inline_rows(aggregate(df, aggs), structs)


def column_profile(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """One row for one column: counts, then statistics (numeric) or the top value (otherwise)."""
    require_columns(df, [name])
    numeric = kind_of(df.schema[name].dataType) == NUMERIC
    x = present(df, name)
    # One row per distinct value: every figure below is a sum over it.
    per_value = df.groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("r"), F.col("v").cast("string").alias("v"))))
    counts = per_value.agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("non_null"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("missing"),
        F.count("v").alias("unique"),
        best.alias("best"),
    )
    head = [
        F.lit(name).alias("column"),
        F.lit(kind_of(df.schema[name].dataType)).alias("kind"),
        "non_null",
        "missing",
        F.expr("round(try_divide(missing * 100.0D, missing + non_null), 1)").alias("missing_pct"),
        "unique",
    ]
    none = F.lit(None)
    if not numeric:
        stats = [none.cast("double").alias(k) for k in ("mean", "std", "min", "max", "median")]
        tail = [F.col("best.v").alias("top_value"), (-F.col("best.r")).cast("bigint").alias("top_count")]
        return counts.select(*head, *stats, *tail)
    base = base_stats(df, [name])
    b = base[name]
    median = quantiles(df, {name: [0.5]}, base, exact)[name][0]
    d = F.col("v").cast("double") - F.lit(b.mean if b.mean is not None else 0.0)
    with_std = per_value.agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("non_null"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("missing"),
        F.count("v").alias("unique"),
        F.sum(d * d * F.col("n")).alias("m2"),
    )
    values = {
        "mean": F.lit(b.mean),
        "std": F.expr(sample_std("m2", b)),
        "min": F.lit(b.low),
        "max": F.lit(b.high),
        "median": F.lit(median),
    }
    stats = [F.round(e.cast("double"), 4).alias(k) for k, e in values.items()]
    return with_std.select(*head, *stats, none.cast("string").alias("top_value"), none.cast("bigint").alias("top_count"))


def feature_summary(df: DataFrame) -> DataFrame:
    """Total, numeric and other columns with names and row count."""
    numeric = len(numeric_columns(df))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(len(df.columns)).cast("int").alias("total_features"),
        F.lit(numeric).cast("int").alias("numeric"),
        F.lit(len(df.columns) - numeric).cast("int").alias("non_numeric"),
        F.lit(", ".join(df.columns)).alias("columns"),
        "rows",
    )


def sample_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first n rows by an explicit order; Spark tables have no row order of their own."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


# --- reports -----------------------------------------------------------------------------------


def _entry(section: str, item: str, metric: str, value: str = "NULL", text: str = "NULL") -> str:
    return (
        f"named_struct('section', '{section}', 'item', {literal_sql(item)}, 'metric', '{metric}', "
        f"'value', CAST({value} AS DOUBLE), 'text', CAST({text} AS STRING))"
    )


def _missing_entries(df: DataFrame, digits: int) -> tuple[list[str], list[str]]:
    aggs = ["count(1) AS rows"] + [f"count_if({missing_sql(df, c)}) AS miss{i}" for i, c in enumerate(df.columns)]
    total = " + ".join(f"miss{i}" for i in range(len(df.columns))) or "0"
    cells = f"rows * {len(df.columns)}"
    entries = [
        _entry("shape", "dataset", "rows", "rows"),
        _entry("shape", "dataset", "columns", str(len(df.columns))),
        _entry("missing", "dataset", "cells", total),
        _entry("missing", "dataset", "pct", f"round(try_divide(({total}) * 100.0D, {cells}), {digits})"),
    ]
    return aggs, entries


def _frequency_entries(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct count and mode of text columns as report rows."""
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], REPORT_SCHEMA)
    per_column = (
        freq_table(df, names)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct"), F.min(F.struct((-F.col("count")).alias("r"), "value")).alias("best"))
    )
    return per_column.selectExpr(
        "inline(array("
        "named_struct('section', 'categorical', 'item', column, 'metric', 'unique', 'value', CAST(distinct AS DOUBLE), 'text', CAST(NULL AS STRING)),"
        "named_struct('section', 'categorical', 'item', column, 'metric', 'mode', 'value', CAST(NULL AS DOUBLE), 'text', best.value)))"
    )


def local_report(df: DataFrame, max_columns: int = 8, worst: int = 5, threshold: float = 0.5, strongest: int = 5) -> DataFrame:
    """The deterministic answer about a table, as ``(section, item, metric, value, text)`` rows.

    Shape, missing cells and worst columns, duplicates, numeric summary, categorical summary and
    strong correlations. All numeric and missing figures come out of one aggregation.
    """
    names = numeric_columns(df)
    base = base_stats(df, names)
    aggs, entries = _missing_entries(df, 1)
    arrays = [f"array({', '.join(entries)})"]

    ordered = ", ".join(
        f"named_struct('k', -miss{i}, 'ord', {i}, 'e', {_entry('missing', c, 'worst', f'miss{i}')})" for i, c in enumerate(df.columns)
    )
    arrays.append(f"transform(slice(array_sort(filter(array({ordered}), z -> z.k < 0)), 1, {worst}), z -> z.e)")

    numeric = []
    for i, n in enumerate(names[:max_columns]):
        b = base[n]
        if not b.n:
            continue
        aggs += power_sums(df, n, b, str(i), powers=(2,))
        for metric, v in (("mean", literal_sql(b.mean)), ("std", sample_std(f"m2_{i}", b)), ("min", literal_sql(b.low)), ("max", literal_sql(b.high))):
            numeric.append(_entry("numeric", n, metric, f"round({v}, 4)"))
    if numeric:
        arrays.append(f"array({', '.join(numeric)})")
    body = inline_rows_of_arrays(aggregate(df, aggs), arrays)

    duplicates = duplicate_profile(df).selectExpr(
        "'duplicates' AS section", "'dataset' AS item", "'rows' AS metric", "CAST(duplicate_rows AS DOUBLE) AS value", "CAST(NULL AS STRING) AS text"
    )
    pairs = correlation_pairs(df, names, base).where(F.abs("r") > threshold)
    strong = pairs.orderBy(F.desc(F.abs("r")), "ord_a", "ord_b").limit(strongest).selectExpr(
        "'correlation' AS section", "col_a AS item", "'r' AS metric", "round(r, 3) AS value", "col_b AS text"
    )
    cats = _frequency_entries(df, categorical_columns(df)[:max_columns])
    return body.unionByName(duplicates).unionByName(cats).unionByName(strong)


def inline_rows_of_arrays(aggregated: DataFrame, arrays: list[str]) -> DataFrame:
    return aggregated.selectExpr(f"inline(concat({', '.join(arrays)}))")


def dataset_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Shape, column names, kinds, missing share, quartile table and top values as report rows."""
    names, cats = numeric_columns(df), categorical_columns(df)
    aggs, entries = _missing_entries(df, 1)
    entries += [_entry("columns", c, "position", str(i + 1)) for i, c in enumerate(df.columns[:20])]
    entries += [_entry("kind", "numeric", "count", str(len(names))), _entry("kind", "categorical", "count", str(len(cats)))]
    entries += [_entry("kind", c, "member", text="'numeric'") for c in names[:10]]
    entries += [_entry("kind", c, "member", text="'categorical'") for c in cats[:10]]
    shown = names[:6]
    base = base_stats(df, shown)
    q = quantiles(df, {n: [0.25, 0.5, 0.75] for n in shown}, base, exact)
    for i, n in enumerate(shown):
        b = base[n]
        aggs += power_sums(df, n, b, str(i), powers=(2,))
        stats = [("count", f"{b.n}"), ("mean", literal_sql(b.mean)), ("std", sample_std(f"m2_{i}", b)), ("min", literal_sql(b.low))]
        stats += [(k, literal_sql(v)) for k, v in zip(("q25", "q50", "q75"), q[n])] + [("max", literal_sql(b.high))]
        entries += [_entry("stats", n, k, f"round(CAST({v} AS DOUBLE), 2)") for k, v in stats]
    body = inline_rows(aggregate(df, aggs), entries)
    if not cats:
        return body
    top = top_values(freq_table(df, cats[:3]), 5).selectExpr(
        "'top_values' AS section", "column AS item", "concat('rank ', rank) AS metric", "CAST(count AS DOUBLE) AS value", "value AS text"
    )
    return body.unionByName(top)

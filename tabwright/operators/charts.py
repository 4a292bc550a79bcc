"""Chart-ready tables: the data behind each chart, aggregated by Spark.

Bounds come from one small aggregation and enter the second pass as literals, so every chart is a
filterless narrow scan plus a partial aggregation; nothing is joined to the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kinds import DATETIME, NUMERIC, categorical_columns, col, kind_of, numeric_columns, quoted, require_columns
from ..functions.missing import as_double, double_sql, literal_sql, present
from ..session import ship_package
from .correlation import collect_pairs, correlation_matrix
from .filters import finite_rows, rows_of_top_groups
from .frequencies import freq_table, top_values, value_counts
from .moments import Base, BaseStats, aggregate, base_stats, inline_rows, power_sums
from .ordering import with_position
from .quantiles import quantiles



def _need_numeric(df: DataFrame, names: list[str]) -> None:
    require_columns(df, names)
    wrong = [n for n in names if kind_of(df.schema[n].dataType) != NUMERIC]
    if wrong:
        raise ValueError(f"numeric column(s) required, got {wrong}")


# --- histograms --------------------------------------------------------------------------------


def _edges(b: Base) -> tuple[float, float]:
    """Histogram range; a constant column is widened by one half on both sides."""
    return (b.low, b.high) if b.low != b.high else (b.low - 0.5, b.high + 0.5)


def _finite(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns with infinite values as NULL."""
    inf = "CAST('Infinity' AS DOUBLE)"
    return df.selectExpr(*[f"IF(abs({double_sql(df, n)}) = {inf}, CAST(NULL AS DOUBLE), {double_sql(df, n)}) AS {quoted(n)}" for n in names])


def _finite_base(df: DataFrame, names: list[str], base: BaseStats | None) -> BaseStats:
    """Bounds and means of the finite values; ``base`` serves as it is unless a column holds infinite ones."""
    base = base or base_stats(df, names)
    if all(math.isfinite(v) for n in names for v in (base[n].low, base[n].high) if v is not None):
        return base
    return base_stats(_finite(df, names), names)


def _bin_sql(x: str, lo: float, hi: float, bins: int) -> str:
    """0-based equal-width bin, closed on the right for the last bin; NULL stays NULL."""
    at = f"floor(({x} - {literal_sql(lo)}) / {literal_sql(hi - lo)} * {bins}D)"
    # ``least`` skips NULL, so missing values need their own branch.
    return f"CAST(IF({x} IS NULL, NULL, least({at}, {bins - 1})) AS INT)"


def auto_bins(n: int) -> int:
    return min(50, max(10, n // 20))


def histograms(df: DataFrame, names: list[str], bins: int | None = 30, base: BaseStats | None = None) -> DataFrame:
    """Equal-width counts of several columns in one pass: ``(column, bin, bin_start, bin_end, count)``.

    ``bins=None`` picks the number of bins from the row count. Empty bins are listed with 0. Infinite
    values lie in no bin: a column that has any gets one more row, without bin and bounds, for them.
    """
    _need_numeric(df, names)
    base = _finite_base(df, names, base)
    spark = df.sparkSession
    spine, structs = [], []
    for i, n in enumerate(names):
        b = base[n]
        if not b.n:
            continue
        lo, hi = _edges(b)
        k = bins or auto_bins(b.n)
        width = (hi - lo) / k
        spine += [(n, j, lo + j * width, hi if j == k - 1 else lo + (j + 1) * width) for j in range(k)]
        x = double_sql(df, n)
        at = f"IF(abs({x}) = CAST('Infinity' AS DOUBLE), -1, {_bin_sql(x, lo, hi, k)})"
        structs.append(f"named_struct('column', {literal_sql(n)}, 'bin', {at})")
    frame = spark.createDataFrame(spine, "column string, bin int, bin_start double, bin_end double")
    if not structs:
        return frame.withColumn("count", F.lit(0).cast("bigint"))
    counts = inline_rows(df, structs).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    # Both sides hold at most columns x (bins + 1) rows.
    return frame.join(F.broadcast(counts), ["column", "bin"], "full").select(
        "column", F.expr("nullif(bin, -1)").alias("bin"), "bin_start", "bin_end", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def histogram(df: DataFrame, name: str, bins: int | None = 30) -> DataFrame:
    return histograms(df, [name], bins).drop("column")


def categorical_histogram(df: DataFrame, name: str, k: int = 20) -> DataFrame:
    return bar(df, name, k)


def all_distributions(df: DataFrame, max_columns: int = 9, bins: int = 30) -> DataFrame:
    return histograms(df, numeric_columns(df)[:max_columns], bins)


# --- bars, shares, running totals ---------------------------------------------------------------


def bar(df: DataFrame, name: str, k: int = 15) -> DataFrame:
    """The k most frequent values with a short label: ``(rank, value, label, count)``."""
    return value_counts(df, name, k).select("rank", "value", F.left(F.col("value").cast("string"), F.lit(15)).alias("label"), "count")


def bar3d(df: DataFrame, name: str, k: int = 12) -> DataFrame:
    return bar(df, name, k)


def shares(df: DataFrame, name: str, k: int = 8) -> DataFrame:
    """The k most frequent values with their share of the shown total."""
    # The window sees the k rows of the top-k only.
    return value_counts(df, name, k).withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def pie(df: DataFrame, name: str, k: int = 8) -> DataFrame:
    return shares(df, name, k)


def treemap(df: DataFrame, name: str, k: int = 12) -> DataFrame:
    return shares(df, name, k).withColumnRenamed("share", "proportion")


def waterfall(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """Top-k counts stacked: ``(rank, value, count, start, end)``."""
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("count").over(running)
    return value_counts(df, name, k).withColumn("end", upto).select("rank", "value", "count", (F.col("end") - F.col("count")).alias("start"), "end")


# --- binned bars ---------------------------------------------------------------------------------


def _cut(df: DataFrame, x: str, bins: int) -> tuple[str, list[tuple[int, float, float]]]:
    """Right-closed equal-width bins; the first edge is lowered so that the minimum is inside."""
    b = base_stats(df, [x])[x]
    if not b.n:
        return "CAST(NULL AS INT)", []
    lo, hi = b.low, b.high
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
    width = (hi - lo) / bins
    lowered = lo - (hi - lo) * 0.001 if b.low != b.high else lo
    edges = [(i, lowered if i == 1 else lo + (i - 1) * width, hi if i == bins else lo + i * width) for i in range(1, bins + 1)]
    v = double_sql(df, x)
    text = f"CAST(IF({v} IS NULL, NULL, least(greatest(ceil(({v} - {literal_sql(lo)}) / {literal_sql(width)}), 1), {bins})) AS INT)"
    return text, edges


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mean of y per bin of x; empty bins are left out."""
    _need_numeric(df, [x, y])
    bucket, edges = _cut(df, x, bins)
    frame = df.sparkSession.createDataFrame(edges, "bin int, bin_start double, bin_end double")
    means = df.select(F.expr(bucket).alias("bin"), as_double(df, y).alias("y")).where("bin IS NOT NULL").groupBy("bin").agg(
        F.avg("y").alias("mean"), F.count(F.lit(1)).alias("count")
    )
    return frame.join(F.broadcast(means), "bin").select("bin", "bin_start", "bin_end", "mean", "count")


def binned_count(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """Rows per bin of x in bin order, empty bins included."""
    _need_numeric(df, [x])
    bucket, edges = _cut(df, x, bins)
    frame = df.sparkSession.createDataFrame(edges, "bin int, bin_start double, bin_end double")
    counts = df.select(F.expr(bucket).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return frame.join(F.broadcast(counts), "bin", "left").select("bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


# --- boxes, means, densities ----------------------------------------------------------------------


def box_stats(df: DataFrame, names: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers (most extreme value inside 1.5 IQR) and outlier count per column."""
    names = numeric_columns(df)[:10] if names is None else names
    _need_numeric(df, names)
    base = base_stats(df, names)
    names = [n for n in names if base[n].n]
    q = quantiles(df, {n: [0.25, 0.5, 0.75] for n in names}, base, exact)
    aggs, structs = ["count(1) AS rows"], []
    for i, n in enumerate(names):
        q1, q2, q3 = q[n]
        lo, hi = literal_sql(q1 - 1.5 * (q3 - q1)), literal_sql(q3 + 1.5 * (q3 - q1))
        x = double_sql(df, n)
        aggs += [
            f"min(CASE WHEN {x} >= {lo} THEN {x} END) AS lo{i}",
            f"max(CASE WHEN {x} <= {hi} THEN {x} END) AS hi{i}",
            f"count_if({x} < {lo} OR {x} > {hi}) AS out{i}",
        ]
        structs.append(
            f"named_struct('column', {literal_sql(n)}, 'q1', {literal_sql(q1)}, 'median', {literal_sql(q2)}, 'q3', {literal_sql(q3)}, "
            f"'whisker_low', least(lo{i}, {literal_sql(q1)}), 'whisker_high', greatest(hi{i}, {literal_sql(q3)}), 'outliers', out{i})"
        )
    return inline_rows(aggregate(df, aggs), structs)


def radar(df: DataFrame, max_columns: int = 8) -> DataFrame:
    """Means of the first numeric columns, scaled to 0..1 across columns."""
    names = numeric_columns(df)[:max_columns]
    if len(names) < 3:
        raise ValueError(f"a radar chart needs 3 or more numeric columns, found {len(names)}")
    means = aggregate(df, [f"avg({double_sql(df, n)}) AS m{i}" for i, n in enumerate(names)])
    every = f"array({', '.join(f'm{i}' for i in range(len(names)))})"
    structs = []
    for i, n in enumerate(names):
        spread = f"(array_max({every}) - array_min({every}))"
        scaled = f"CASE WHEN {spread} > 0 THEN (m{i} - array_min({every})) / {spread} ELSE m{i} END"
        structs.append(f"named_struct('column', {literal_sql(n)}, 'position', {i}, 'mean', m{i}, 'scaled', {scaled})")
    return inline_rows(means, structs)


def densities(df: DataFrame, names: list[str], points: int = 300, base: BaseStats | None = None, reach: float = 12.0) -> DataFrame:
    """Gaussian kernel densities of the finite values with Scott bandwidth: ``(column, point, x, density)``.

    Each task adds up its rows' kernels on the grid and emits grid-sized partial sums, so the
    shuffle carries columns x points rows per task. Kernels farther than ``reach`` bandwidths from a
    grid point, which add less than 1e-31 to it by default, are left out there.
    """
    _need_numeric(df, names)
    base = _finite_base(df, names, base)
    df = _finite(df, names)
    names = [n for n in names if base[n].n > 1 and not base[n].constant]
    empty = df.sparkSession.createDataFrame([], "column string, point int, x double, density double")
    if not names:
        return empty
    sums = aggregate(df, [s for i, n in enumerate(names) for s in power_sums(df, n, base[n], str(i), powers=(2,))]).first()
    setup = []
    for i, n in enumerate(names):
        b = base[n]
        h = (sums[f"m2_{i}"] / (b.n - 1)) ** 0.5 * b.n ** (-0.2)
        step = (b.high - b.low) / (points - 1)
        setup.append((h, [b.low + j * step for j in range(points)]))

    def kernel_sums(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(setup), points))
        for batch in batches:
            for c, (h, grid) in enumerate(setup):
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                values, weights = np.unique(x[~np.isnan(x)], return_counts=True)
                at = np.asarray(grid)
                first = np.searchsorted(values, at - reach * h)
                last = np.searchsorted(values, at + reach * h, side="right")
                for j in range(points):
                    z = (at[j] - values[first[j] : last[j]]) / h
                    total[c, j] += float(np.dot(weights[first[j] : last[j]], np.exp(-0.5 * z * z)))
        c, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.ravel().astype("int32")), pa.array(j.ravel().astype("int32")), pa.array(total.ravel())], names=["c", "point", "s"]
        )

    ship_package(df.sparkSession)
    narrow = df.selectExpr(*[f"{double_sql(df, n)} AS x{i}" for i, n in enumerate(names)])
    partial = narrow.mapInArrow(kernel_sums, "c int, point int, s double").groupBy("c", "point").agg(F.sum("s").alias("s"))
    labels = F.array(*[F.lit(n) for n in names])
    lows = F.array(*[F.lit(base[n].low) for n in names])
    steps = F.array(*[F.lit((base[n].high - base[n].low) / (points - 1)) for n in names])
    scales = F.array(*[F.lit(base[n].n * h * math.sqrt(2 * math.pi)) for n, (h, _) in zip(names, setup)])
    at = F.col("c") + 1
    return partial.select(
        F.element_at(labels, at).alias("column"),
        "point",
        (F.element_at(lows, at) + F.col("point") * F.element_at(steps, at)).alias("x"),
        (F.col("s") / F.element_at(scales, at)).alias("density"),
    )


def density(df: DataFrame, name: str, points: int = 300) -> DataFrame:
    return densities(df, [name], points).drop("column")


def violin(df: DataFrame, max_columns: int = 8, points: int = 100, exact: bool = True) -> DataFrame:
    """Density outline per numeric column with its mean and median."""
    names = numeric_columns(df)[:max_columns]
    base = base_stats(df, names)
    median = quantiles(df, {n: [0.5] for n in names}, base, exact)
    marks = df.sparkSession.createDataFrame([(n, base[n].mean, median[n][0]) for n in names if base[n].n], "column string, mean double, median double")
    return densities(df, names, points, base).join(F.broadcast(marks), "column")


# --- points and series ----------------------------------------------------------------------------


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every row with both values present."""
    return df.select(present(df, x).alias("x"), present(df, y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def _axis_sql(df: DataFrame, name: str) -> str:
    if kind_of(df.schema[name].dataType) == DATETIME:
        return f"CAST(unix_micros(CAST({quoted(name)} AS TIMESTAMP)) AS DOUBLE)"
    return double_sql(df, name)


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Rows per occupied cell of a bins x bins grid: the scatter of a table too large to draw."""
    points = df.selectExpr(f"{_axis_sql(df, x)} AS x", f"{_axis_sql(df, y)} AS y").where("x IS NOT NULL AND y IS NOT NULL")
    base = base_stats(points, ["x", "y"])
    if not base["x"].n:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, x double, y double, count bigint")
    (xl, xh), (yl, yh) = _edges(base["x"]), _edges(base["y"])
    cells = points.selectExpr(f"{_bin_sql('x', xl, xh, bins)} AS x_bin", f"{_bin_sql('y', yl, yh, bins)} AS y_bin")
    return cells.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count")).selectExpr(
        "x_bin",
        "y_bin",
        f"{literal_sql(xl)} + x_bin * {literal_sql((xh - xl) / bins)} AS x",
        f"{literal_sql(yl)} + y_bin * {literal_sql((yh - yl) / bins)} AS y",
        "count",
    )


def scatter_grouped(df: DataFrame, x: str, y: str, color: str, k: int = 10) -> DataFrame:
    """Points of the k most frequent groups: ``(group, x, y)``."""
    kept = rows_of_top_groups(df, color, k)
    return kept.select(F.left(col(color).cast("string"), F.lit(20)).alias("group"), present(df, x).alias("x"), present(df, y).alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL"
    )


def line_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every point in x order (a distributed range sort)."""
    _need_numeric(df, [y])
    return df.select(present(df, x).alias("x"), present(df, y).alias("y")).orderBy("x", "y")


def line_series(df: DataFrame, x: str, y: str, points: int = 500) -> DataFrame:
    """y over equal-width steps of x: first and last x, mean, min and max of y, and row count."""
    _need_numeric(df, [y])
    axis = df.select(F.expr(_axis_sql(df, x)).alias("__a"), present(df, x).alias("x"), as_double(df, y).alias("y")).where("__a IS NOT NULL")
    b = base_stats(axis, ["__a"])["__a"]
    if not b.n:
        return axis.select(F.lit(0).alias("step"), F.col("x").alias("x_first"), F.col("x").alias("x_last"), F.col("y").alias("y_mean"), F.col("y").alias("y_min"), F.col("y").alias("y_max"), F.lit(0).cast("bigint").alias("count"))
    lo, hi = _edges(b)
    return axis.withColumn("step", F.expr(_bin_sql("__a", lo, hi, points))).groupBy("step").agg(
        F.min("x").alias("x_first"),
        F.max("x").alias("x_last"),
        F.avg("y").alias("y_mean"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.count(F.lit(1)).alias("count"),
    )


def area_points(df: DataFrame, y: str, order_by: list[str]) -> DataFrame:
    """y against its 0-based row position in an explicit order."""
    _need_numeric(df, [y])
    return with_position(df, order_by, "position", keep=[y]).select("position", col(y).alias("y"))


def area_series(df: DataFrame, y: str, order_by: list[str], points: int = 500) -> DataFrame:
    """Positions grouped into equal steps: mean, min and max of y per step."""
    placed = area_points(df, y, order_by)
    n = df.count()
    clean = placed.select("position", as_double(placed, "y").alias("y"))
    return clean.withColumn("step", F.expr(f"CAST(position * {points} DIV {max(n, 1)} AS INT)")).groupBy("step").agg(
        F.min("position").alias("position_first"),
        F.max("position").alias("position_last"),
        F.avg("y").alias("y_mean"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.count(F.lit(1)).alias("count"),
    )


def bubble(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """Points with a marker size of 20 + 400 * min-max(|z|); 50 when z is constant or absent."""
    _need_numeric(df, [x, y] + ([z] if z else []))
    size = "50.0D"
    if z:
        weight = f"abs(coalesce({double_sql(df, z)}, 0.0D))"
        b = base_stats(df.selectExpr(f"{weight} AS w"), ["w"])["w"]
        if b.n and not b.constant:
            size = f"20.0D + ({weight} - {literal_sql(b.low)}) / {literal_sql(b.high - b.low)} * 400.0D"
    return df.selectExpr(f"{double_sql(df, x)} AS x", f"{double_sql(df, y)} AS y", f"{size} AS size").where("x IS NOT NULL AND y IS NOT NULL")


def scatter3d(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    _need_numeric(df, [x, y, z])
    return finite_rows(df, [x, y, z]).selectExpr(*[f"{double_sql(df, c)} AS {k}" for c, k in ((x, "x"), (y, "y"), (z, "z"))])


# --- grids ------------------------------------------------------------------------------------------


def grid(df: DataFrame, x: str, y: str, z: str | None = None, n: int = 40) -> DataFrame:
    """Mean of z (or row count) at the nearest node of an n x n grid; empty nodes hold 0.

    Surface, wireframe and contour charts use n = 40, 30 and 50.
    """
    _need_numeric(df, [x, y] + ([z] if z else []))
    used = finite_rows(df, [x, y])
    base = base_stats(used, [x, y])
    if not base[x].n:
        return df.sparkSession.createDataFrame([], "i int, j int, x double, y double, z double, count bigint")

    def node(name: str) -> str:
        b = base[name]
        if b.constant:
            return "0"
        return f"CAST(floor(({double_sql(df, name)} - {literal_sql(b.low)}) / {literal_sql(b.high - b.low)} * {n - 1}D + 0.5D) AS INT)"

    value = double_sql(df, z) if z else "CAST(NULL AS DOUBLE)"
    # One zero-weight row per node keeps empty nodes in the result without a join.
    spine = df.sparkSession.range(n * n).selectExpr(
        f"CAST(id DIV {n} AS INT) AS i", f"CAST(id % {n} AS INT) AS j", "CAST(NULL AS DOUBLE) AS v", "0 AS w"
    )
    rows = used.selectExpr(f"{node(x)} AS i", f"{node(y)} AS j", f"{value} AS v", "1 AS w")
    cells = rows.unionByName(spine).groupBy("i", "j").agg(F.avg("v").alias("m"), F.sum("w").cast("bigint").alias("count"))
    height = "coalesce(m, 0.0D)" if z else "CAST(count AS DOUBLE)"

    def at(name: str, k: str) -> str:
        b = base[name]
        return f"{literal_sql(b.low)} + {k} * {literal_sql((b.high - b.low) / (n - 1))}"

    return cells.selectExpr("i", "j", f"{at(x, 'i')} AS x", f"{at(y, 'j')} AS y", f"{height} AS z", "count")


def surface(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    return grid(df, x, y, z, 40)


def wireframe(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    return grid(df, x, y, z, 30)


def contour(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    return grid(df, x, y, z, 50)


def pair_panels(df: DataFrame, max_columns: int = 4, bins: int = 20) -> DataFrame:
    """Pair plot: histograms on the diagonal, 2-D cell counts off it.

    ``(row, col, x_bin, y_bin, count)``; the panel (row, col) has ``col`` on x and ``row`` on y. The
    lower triangle is counted, the upper one is its mirror image.
    """
    names = numeric_columns(df)[:max_columns]
    if len(names) < 2:
        raise ValueError("a pair plot needs 2 or more numeric columns")
    base = base_stats(df, names)
    bin_of = {}
    for n in names:
        lo, hi = _edges(base[n]) if base[n].n else (0.0, 1.0)
        bin_of[n] = _bin_sql(double_sql(df, n), lo, hi, bins)
    binned = df.selectExpr(*[f"{bin_of[n]} AS b{i}" for i, n in enumerate(names)])
    structs = []
    for i in range(len(names)):
        for j in range(i + 1):
            y = "CAST(NULL AS INT)" if i == j else f"b{i}"
            ok = f"b{j} IS NOT NULL" if i == j else f"b{j} IS NOT NULL AND b{i} IS NOT NULL"
            structs.append(f"named_struct('i', {i}, 'j', {j}, 'x_bin', b{j}, 'y_bin', {y}, 'ok', {ok})")
    counts = inline_rows(binned, structs).where("ok").groupBy("i", "j", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))
    cell = "named_struct('i', {0}, 'j', {1}, 'x_bin', {2}, 'y_bin', {3}, 'count', count)"
    here, there = cell.format("i", "j", "CAST(x_bin AS INT)", "y_bin"), cell.format("j", "i", "y_bin", "x_bin")
    mirrored = counts.selectExpr(f"inline(IF(i = j, array({here}), array({here}, {there})))")
    labels = F.array(*[F.lit(n) for n in names])
    return mirrored.select(
        F.element_at(labels, F.col("i") + 1).alias("row"), F.element_at(labels, F.col("j") + 1).alias("col"), "x_bin", "y_bin", "count"
    )


# --- composed overviews -------------------------------------------------------------------------------

_TAGGED = "chart string, series string, label string, x double, y double, value double"


def _tag_histograms(df: DataFrame, names: list[str], bins: int, base: BaseStats) -> DataFrame:
    return histograms(df, names, bins, base).selectExpr(
        "'histogram' AS chart", "column AS series", "CAST(NULL AS STRING) AS label", "bin_start AS x", "bin_end AS y", "CAST(count AS DOUBLE) AS value"
    )


def _tag_bars(df: DataFrame, names: list[str], k: int) -> DataFrame:
    return top_values(freq_table(df, names), k).selectExpr(
        "'bar' AS chart", "column AS series", "value AS label", "CAST(rank AS DOUBLE) AS x", "CAST(NULL AS DOUBLE) AS y", "CAST(count AS DOUBLE) AS value"
    )


def auto_charts(df: DataFrame, bins: int = 30, top_n: int = 15, cells: int = 50) -> DataFrame:
    """First numeric histogram, strongest pair, first categorical bars and the heatmap as one table."""
    names, cats = numeric_columns(df), categorical_columns(df)
    parts = []
    if names:
        parts.append(_tag_histograms(df, names[:1], bins, base_stats(df, names[:1])))
    if len(names) >= 2:
        pairs = collect_pairs(df, names)
        if pairs:
            a, b, _ = max(pairs, key=lambda p: abs(p[2]))
            parts.append(
                scatter_grid(df, a, b, cells).selectExpr(
                    "'scatter' AS chart", f"{literal_sql(a)} AS series", f"{literal_sql(b)} AS label", "x", "y", "CAST(count AS DOUBLE) AS value"
                )
            )
    if cats:
        parts.append(_tag_bars(df, cats[:1], top_n))
    if len(names) >= 3:
        parts.append(
            correlation_matrix(df).selectExpr(
                "'heatmap' AS chart", "row AS series", "col AS label", "CAST(NULL AS DOUBLE) AS x", "CAST(NULL AS DOUBLE) AS y", "r AS value"
            )
        )
    if not parts:
        return df.sparkSession.createDataFrame([], _TAGGED)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overview(df: DataFrame, bins: int = 30, k: int = 8) -> DataFrame:
    """Up to four histograms and up to two bar panels."""
    names, cats = numeric_columns(df)[:4], categorical_columns(df)[:2]
    parts = []
    if names:
        parts.append(_tag_histograms(df, names, bins, base_stats(df, names)))
    if cats:
        parts.append(_tag_bars(df, cats, k))
    if not parts:
        return df.sparkSession.createDataFrame([], _TAGGED)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def model_comparison(results: DataFrame, metric: str) -> DataFrame:
    """Bars of the models that trained, best first."""
    return results.where(F.col("error").isNull()).select("model", F.lit(metric).alias("metric"), col(metric).alias("value")).orderBy(F.desc("value"), "model")

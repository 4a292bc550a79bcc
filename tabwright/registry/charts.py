"""Registered queries: chart-ready tables."""

from __future__ import annotations

from ..operators import charts as ops
from .base import LINE_NUMERIC, Query, dirty, rounded, sql_hist, sql_pairs, sql_top, table, union_all, with_d

LINE_TEXT = ["l_returnflag", "l_linestatus"]


def _kde(src, c, points):
    """(point, x, density) of one column."""
    return f"""SELECT g.i::INTEGER AS point, round(m.lo+g.i*((m.hi-m.lo)/{points - 1}),6) AS x,
round(sum(v.n*exp(-0.5*pow((m.lo+g.i*((m.hi-m.lo)/{points - 1})-v.x)/m.h,2)))/(any_value(m.n)*any_value(m.h)*sqrt(2*pi())),6) AS density
FROM (SELECT {c}::DOUBLE AS x, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) v
CROSS JOIN (SELECT min({c})::DOUBLE lo, max({c})::DOUBLE hi, count({c}) n, stddev_samp({c}::DOUBLE)*pow(count({c}),-0.2) h FROM {src}) m
CROSS JOIN range({points}) g(i) GROUP BY g.i, m.lo, m.hi"""


def _bin(c, b, bins, src):
    return f"least(floor(({c}::DOUBLE-(SELECT min({c})::DOUBLE FROM {src}))/(SELECT max({c})::DOUBLE-min({c})::DOUBLE FROM {src})*{bins}::DOUBLE),{bins - 1})::INTEGER AS {b}"


def _scatter_grid_sql(src, x, y, bins):
    start = lambda c, b: f"round((SELECT min({c})::DOUBLE FROM {src})+{b}*(SELECT (max({c})::DOUBLE-min({c})::DOUBLE)/{bins} FROM {src}),6)"
    return f"""SELECT x_bin, y_bin, {start(x, 'x_bin')} AS x, {start(y, 'y_bin')} AS y, count(*) AS count
FROM (SELECT {_bin(x, 'x_bin', bins, src)}, {_bin(y, 'y_bin', bins, src)} FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY x_bin, y_bin"""


def _grid_sql(src, x, y, z, n):
    node = lambda c: f"floor(({c}::DOUBLE-(SELECT min({c})::DOUBLE FROM {src}))/(SELECT max({c})::DOUBLE-min({c})::DOUBLE FROM {src})*{n - 1}::DOUBLE+0.5)::INTEGER"
    at = lambda c, k: f"round((SELECT min({c})::DOUBLE FROM {src})+{k}*(SELECT (max({c})::DOUBLE-min({c})::DOUBLE)/{n - 1} FROM {src}),6)"
    mean = f"round(coalesce(c.m,0.0),6)" if z else "coalesce(c.n,0)::DOUBLE"
    agg = f"avg({z}::DOUBLE)" if z else "NULL"
    return f"""SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, {at(x, 'a.i')} AS x, {at(y, 'b.j')} AS y, {mean} AS z, coalesce(c.n,0)::BIGINT AS count
FROM range({n}) a(i) CROSS JOIN range({n}) b(j) LEFT JOIN (SELECT i, j, {agg} AS m, count(*) AS n FROM (SELECT {node(x)} AS i, {node(y)} AS j, * FROM {src}) GROUP BY 1,2) c ON a.i=c.i AND b.j=c.j"""


def _box_sql(src, names):
    return union_all(
        f"""SELECT '{c}' AS "column", round(q1,6) AS q1, round(q2,6) AS median, round(q3,6) AS q3,
round(least(min(x) FILTER (WHERE x>=q1-1.5*(q3-q1)),q1),6) AS whisker_low, round(greatest(max(x) FILTER (WHERE x<=q3+1.5*(q3-q1)),q3),6) AS whisker_high,
count(*) FILTER (WHERE x<q1-1.5*(q3-q1) OR x>q3+1.5*(q3-q1)) AS outliers
FROM (SELECT {c}::DOUBLE AS x FROM {src}) CROSS JOIN (SELECT quantile_cont({c}::DOUBLE,0.25) q1, quantile_cont({c}::DOUBLE,0.5) q2, quantile_cont({c}::DOUBLE,0.75) q3 FROM {src}) GROUP BY q1,q2,q3"""
        for c in names
    )


def _cut_sql(src, x, y, bins):
    k = f"least(greatest(ceil((v-lo)/((hi-lo)/{bins})),1),{bins})::INTEGER"
    rows = f"(SELECT {x}::DOUBLE AS v, {y or 'NULL'} AS y FROM {src}) CROSS JOIN (SELECT min({x})::DOUBLE lo, max({x})::DOUBLE hi FROM {src})"
    edge = f"""round(CASE WHEN g.b=1 THEN m.lo-(m.hi-m.lo)*0.001 ELSE m.lo+(g.b-1)*((m.hi-m.lo)/{bins}) END,6) AS bin_start,
round(CASE WHEN g.b={bins} THEN m.hi ELSE m.lo+g.b*((m.hi-m.lo)/{bins}) END,6) AS bin_end"""
    value = "round(h.mean,6) AS mean, h.n AS count" if y else "coalesce(h.n,0)::BIGINT AS count"
    return f"""SELECT g.b::INTEGER AS bin, {edge}, {value} FROM range(1,{bins + 1}) g(b) CROSS JOIN (SELECT min({x})::DOUBLE lo, max({x})::DOUBLE hi FROM {src}) m
{'' if y else 'LEFT '}JOIN (SELECT {k} AS b, avg(y) AS mean, count(*) AS n FROM {rows} WHERE v IS NOT NULL GROUP BY 1) h ON h.b=g.b"""


def _tag_hist(src, c, bins):
    return f"SELECT 'histogram' AS chart, '{c}' AS series, NULL AS label, bin_start AS x, bin_end AS y, count::DOUBLE AS value FROM ({sql_hist(src, c, bins)})"


def _tag_bar(src, c, k):
    return f"SELECT 'bar' AS chart, '{c}' AS series, value AS label, rank::DOUBLE AS x, NULL::DOUBLE AS y, count::DOUBLE AS value FROM ({sql_top(src, c, k)})"


def _pair_sql(names, bins):
    parts = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            x = _bin(b, "x_bin", bins, "lineitem")
            y = "NULL::INTEGER AS y_bin" if i == j else _bin(a, "y_bin", bins, "lineitem")
            parts.append(f"""SELECT '{a}' AS "row", '{b}' AS col, x_bin, y_bin, count(*) AS count FROM (SELECT {x}, {y} FROM lineitem) GROUP BY x_bin, y_bin""")
    return union_all(parts)


def _auto_sql():
    pairs = sql_pairs("part", ["p_partkey", "p_size", "p_retailprice"])
    grid = _scatter_grid_sql("part", "p_partkey", "p_retailprice", 50)
    return union_all(
        [
            _tag_hist("part", "p_partkey", 30),
            f"SELECT 'scatter', 'p_partkey', 'p_retailprice', x, y, count::DOUBLE FROM ({grid})",
            _tag_bar("part", "p_name", 15),
            f"SELECT 'heatmap', col_a, col_b, NULL, NULL, round(r,6) FROM ({pairs})",
            f"SELECT 'heatmap', col_b, col_a, NULL, NULL, round(r,6) FROM ({pairs})",
            *[f"SELECT 'heatmap', '{c}', '{c}', NULL, NULL, 1.0::DOUBLE" for c in ("p_partkey", "p_size", "p_retailprice")],
        ]
    )


_LINE = f"""SELECT step, min(x) AS x_first, max(x) AS x_last, round(avg(y),6) AS y_mean, min(y) AS y_min, max(y) AS y_max, count(*) AS count FROM (
SELECT least(floor((epoch_us(ts)::DOUBLE-lo)/(hi-lo)*200::DOUBLE),199)::INTEGER AS step, ts AS x, value AS y FROM events
CROSS JOIN (SELECT min(epoch_us(ts))::DOUBLE lo, max(epoch_us(ts))::DOUBLE hi FROM events)) GROUP BY step"""
_POSITIONS = "SELECT row_number() OVER (ORDER BY event_id)-1 AS position, value AS y FROM events"

QUERIES = {
    "histogram": Query(lambda s, d: rounded(ops.histogram(table(s, d, "events"), "value")), sql_hist("events", "value", 30)),
    "histogram_auto": Query(lambda s, d: rounded(ops.histogram(table(s, d, "lineitem"), "l_extendedprice", None)), sql_hist("lineitem", "l_extendedprice", 50)),
    "histogram_with_gaps": Query(lambda s, d: rounded(ops.histogram(dirty(s, d), "price", 20)), with_d(sql_hist("d", "price", 20))),
    "binned_mean_with_gaps": Query(lambda s, d: rounded(ops.binned_mean(dirty(s, d), "price", "id"), 3), with_d("SELECT bin, round(bin_start,3) AS bin_start, round(bin_end,3) AS bin_end, round(mean,3) AS mean, count FROM (" + _cut_sql("d", "price", "id", 10) + ")")),
    "density_with_gaps": Query(lambda s, d: rounded(ops.density(dirty(s, d), "sparse80", 100)), with_d(_kde("d", "sparse80", 100))),
    "scatter_grid_with_gaps": Query(lambda s, d: rounded(ops.scatter_grid(dirty(s, d), "sparse80", "price"), 4), with_d("WITH k AS (SELECT * FROM d WHERE price IS NOT NULL AND sparse80 IS NOT NULL) SELECT x_bin, y_bin, round(x,4) AS x, round(y,4) AS y, count FROM (" + _scatter_grid_sql("k", "sparse80", "price", 50) + ")")),
    "categorical_histogram": Query(
        lambda s, d: ops.categorical_histogram(table(s, d, "orders"), "o_orderpriority"),
        f"SELECT rank, value, left(value,15) AS label, count FROM ({sql_top('orders', 'o_orderpriority', 20)})",
    ),
    "binned_mean": Query(lambda s, d: rounded(ops.binned_mean(table(s, d, "lineitem"), "l_quantity", "l_extendedprice")), _cut_sql("lineitem", "l_quantity", "l_extendedprice", 10)),
    "binned_count": Query(lambda s, d: rounded(ops.binned_count(table(s, d, "lineitem"), "l_extendedprice")), _cut_sql("lineitem", "l_extendedprice", None, 10)),
    "bar_top": Query(
        lambda s, d: ops.bar(table(s, d, "part"), "p_brand"), f"SELECT rank, value, left(value,15) AS label, count FROM ({sql_top('part', 'p_brand', 15)})"
    ),
    "bar3d": Query(
        lambda s, d: ops.bar3d(table(s, d, "part"), "p_brand"), f"SELECT rank, value, left(value,15) AS label, count FROM ({sql_top('part', 'p_brand', 12)})"
    ),
    "pie_share": Query(
        lambda s, d: rounded(ops.pie(table(s, d, "part"), "p_brand")),
        f"SELECT rank, value, count, round(count::DOUBLE/sum(count) OVER (),6) AS share FROM ({sql_top('part', 'p_brand', 8)})",
    ),
    "treemap": Query(
        lambda s, d: rounded(ops.treemap(table(s, d, "part"), "p_brand")),
        f"SELECT rank, value, count, round(count::DOUBLE/sum(count) OVER (),6) AS proportion FROM ({sql_top('part', 'p_brand', 12)})",
    ),
    "waterfall": Query(
        lambda s, d: ops.waterfall(table(s, d, "part"), "p_brand"),
        f"""SELECT rank, value, count, (sum(count) OVER (ORDER BY rank)-count)::BIGINT AS start, (sum(count) OVER (ORDER BY rank))::BIGINT AS "end" FROM ({sql_top('part', 'p_brand', 10)})""",
    ),
    "radar": Query(
        lambda s, d: rounded(ops.radar(table(s, d, "lineitem")), 4),
        f"""SELECT "column", position, round(mean,4) AS mean, round((mean-min(mean) OVER ())/(max(mean) OVER ()-min(mean) OVER ()),4) AS scaled FROM ("""
        + union_all(f"""SELECT '{c}' AS "column", {i}::INTEGER AS position, avg({c}::DOUBLE) AS mean FROM lineitem""" for i, c in enumerate(LINE_NUMERIC))
        + ")",
    ),
    "box_stats": Query(lambda s, d: rounded(ops.box_stats(table(s, d, "lineitem"))), _box_sql("lineitem", LINE_NUMERIC)),
    "box_stats_skewed": Query(lambda s, d: rounded(ops.box_stats(table(s, d, "events"), ["value"])), _box_sql("events", ["value"])),
    "density": Query(lambda s, d: rounded(ops.density(table(s, d, "events"), "value")), _kde("events", "value", 300)),
    "violin": Query(
        lambda s, d: rounded(ops.violin(table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax"))),
        union_all(
            f"""SELECT '{c}' AS "column", point, x, density, (SELECT round(avg({c}),6) FROM lineitem) AS mean, (SELECT quantile_cont({c},0.5) FROM lineitem) AS median FROM ({_kde('lineitem', c, 100)})"""
            for c in ("l_quantity", "l_discount", "l_tax")
        ),
    ),
    "bubble": Query(
        lambda s, d: rounded(ops.bubble(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax")),
        """SELECT l_quantity AS x, l_extendedprice AS y, round(20+(abs(l_tax)-(SELECT min(abs(l_tax)) FROM lineitem))/(SELECT max(abs(l_tax))-min(abs(l_tax)) FROM lineitem)*400,6) AS size FROM lineitem""",
    ),
    "bubble_without_size": Query(
        lambda s, d: ops.bubble(table(s, d, "events"), "user_id", "value"), "SELECT user_id::DOUBLE AS x, value AS y, 50.0::DOUBLE AS size FROM events"
    ),
    "scatter_points": Query(lambda s, d: ops.scatter(dirty(s, d), "sparse80", "price"), with_d("SELECT sparse80 AS x, price AS y FROM d WHERE sparse80 IS NOT NULL AND price IS NOT NULL")),
    "scatter_grid": Query(lambda s, d: rounded(ops.scatter_grid(table(s, d, "lineitem"), "l_quantity", "l_extendedprice")), _scatter_grid_sql("lineitem", "l_quantity", "l_extendedprice", 50)),
    "scatter_grouped": Query(
        lambda s, d: ops.scatter_grouped(table(s, d, "part"), "p_size", "p_retailprice", "p_brand"),
        f"""SELECT left(p_brand,20) AS "group", p_size AS x, p_retailprice AS y FROM part WHERE p_brand IN (SELECT value FROM ({sql_top('part', 'p_brand', 10)}))""",
    ),
    "scatter3d": Query(
        lambda s, d: ops.scatter3d(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"),
        "SELECT l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem",
    ),
    "line_points": Query(lambda s, d: ops.line_points(table(s, d, "events"), "ts", "value"), "SELECT ts AS x, value AS y FROM events"),
    "line_series": Query(lambda s, d: rounded(ops.line_series(table(s, d, "events"), "ts", "value", 200)), _LINE),
    "area_points": Query(lambda s, d: ops.area_points(table(s, d, "events"), "value", ["event_id"]), _POSITIONS),
    "area_series": Query(
        lambda s, d: rounded(ops.area_series(table(s, d, "events"), "value", ["event_id"], 200)),
        f"""SELECT (position*200//(SELECT count(*) FROM events))::INTEGER AS step, min(position) AS position_first, max(position) AS position_last,
round(avg(y),6) AS y_mean, min(y) AS y_min, max(y) AS y_max, count(*) AS count FROM ({_POSITIONS}) GROUP BY 1""",
    ),
    "grid_surface": Query(lambda s, d: rounded(ops.surface(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount")), _grid_sql("lineitem", "l_quantity", "l_extendedprice", "l_discount", 40)),
    "grid_wireframe": Query(lambda s, d: rounded(ops.wireframe(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax")), _grid_sql("lineitem", "l_quantity", "l_extendedprice", "l_tax", 30)),
    "grid_contour": Query(lambda s, d: rounded(ops.contour(table(s, d, "events"), "user_id", "value")), _grid_sql("events", "user_id", "value", None, 50)),
    "pair_panels": Query(lambda s, d: ops.pair_panels(table(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")), _pair_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 20)),
    "distributions": Query(
        lambda s, d: rounded(ops.all_distributions(table(s, d, "lineitem"))),
        union_all(f"""SELECT '{c}' AS "column", * FROM ({sql_hist('lineitem', c, 30)})""" for c in LINE_NUMERIC),
    ),
    "overview": Query(
        lambda s, d: rounded(ops.overview(table(s, d, "lineitem"))),
        union_all([_tag_hist("lineitem", c, 30) for c in LINE_NUMERIC[:4]] + [_tag_bar("lineitem", c, 8) for c in LINE_TEXT]),
    ),
    "auto_charts": Query(lambda s, d: rounded(ops.auto_charts(table(s, d, "part"))), _auto_sql()),
}

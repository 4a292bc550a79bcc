"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
value is the median of warm runs, fully evaluated into a ``noop`` sink, and includes the jobs a
query needs before it returns its DataFrame.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabwright.operators import charts, clean, correlation, features, folds, frequencies, knn, models, ordering, profile  # noqa: E402
from tabwright.plans.recipes import clean as run_recipe  # noqa: E402
from tabwright.registry.base import dirty, table  # noqa: E402
from tabwright.session import build_session  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def _one_hot(s):
    df = table(s, SF, "orders")
    for plan in features.fit_one_hot(df):
        df = plan.transform(df)
    return df


def _forest(s):
    df = table(s, SF, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "CAST(left(o_orderpriority,1) AS INT) AS priority_rank", "CAST(datediff(o_orderdate, DATE'1990-01-01') AS INT) AS day", "o_orderstatus"
    )
    return models.train_on_split(df, "o_orderstatus", "o_orderkey", ["random_forest"], folds=0, trees=20, depth=8)


def _knn(s):
    df = table(s, SF, "events").selectExpr("event_id", "CAST(user_id AS DOUBLE) AS user_id", "value", "CAST(hour(ts) AS DOUBLE) AS hour")
    train, test = folds.train_test_split(df, "event_id")
    return knn.nearest(train, test, ["user_id", "hour"], "event_id", "event_id", "value")


def _label_encode(s):
    df = table(s, SF, "customer")
    return features.fit_label_encode(df).transform(df)


QUERIES = {
    "numeric_stats": lambda s: profile.numeric_stats(table(s, SF, "lineitem")),
    "missing_profile": lambda s: profile.missing_profile(dirty(s, SF)),
    "value_counts": lambda s: frequencies.value_counts(table(s, SF, "lineitem"), "l_returnflag", 10),
    "categorical_stats": lambda s: profile.categorical_stats(table(s, SF, "orders")),
    "duplicate_profile": lambda s: profile.duplicate_profile(table(s, SF, "lineitem")),
    "top_correlations": lambda s: correlation.top_correlations(table(s, SF, "lineitem")),
    "dedup": lambda s: clean.remove_duplicates(table(s, SF, "lineitem")),
    "impute_median": lambda s: clean.fit_impute_numeric(dirty(s, SF)).transform(dirty(s, SF)),
    "cap_iqr": lambda s: clean.fit_cap_outliers(table(s, SF, "lineitem")).transform(table(s, SF, "lineitem")),
    "clean_agent": lambda s: run_recipe(dirty(s, SF), "agent").data,
    "one_hot": _one_hot,
    "histogram": lambda s: charts.histogram(table(s, SF, "lineitem"), "l_extendedprice"),
    "distributions": lambda s: charts.all_distributions(table(s, SF, "lineitem")),
    "density": lambda s: charts.density(table(s, SF, "lineitem"), "l_extendedprice"),
    "local_report": lambda s: profile.local_report(table(s, SF, "lineitem")),
    "linear_fit": lambda s: models.linear_coefficients(table(s, SF, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "p_partkey"),
    "random_forest": _forest,
    "knn": _knn,
    "stratified_folds": lambda s: folds.with_stratified_folds(table(s, SF, "orders"), "o_orderstatus", "o_orderkey"),
    "positions": lambda s: ordering.with_position(table(s, SF, "lineitem"), ["l_shipdate"]),
    "label_encode": _label_encode,
}
ONCE = {"random_forest", "clean_agent", "knn"}


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    chosen = sys.argv[1:] or list(QUERIES)
    times = {}
    for name in chosen:
        seen = []
        for run in range((1 if name in ONCE else RUNS) + 1):
            start = time.time()
            QUERIES[name](spark).write.format("noop").mode("overwrite").save()
            if run:
                seen.append(time.time() - start)
        times[name] = round(statistics.median(seen), 3)
        print(name, times[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF)}))


if __name__ == "__main__":
    main()

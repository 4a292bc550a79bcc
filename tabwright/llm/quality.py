"""Quality rules whose thresholds come from mergeable quantile sketches for each language and source.

Everything here is DataFrame work. Each text is measured once (the measures are a few integers for a
row). A sketch counts a measure's values in buckets whose width grows with the value, at most 1/32 of it;
two sketches merge by adding their counts, so tasks combine before the shuffle and a source that holds a
third of all rows costs one row for each task and bucket. Quartiles of a sketch give fences around what
is usual in that language and source, and a join brings them to the rows.

A document fails on fixed rules when it has under ``MIN_WORDS`` words or more than ``MAX_REPEAT_PCT`` % of
its words in repeated windows; such documents don't enter the sketches. Others fail when a measure lies
further from the quartiles than ``IQRS`` times their distance, ``SLACK`` at least (so a source of
nothing but clean text rejects nothing for a trifle).

Defined cases: a null or empty text has no words and fails; null languages and null sources are groups of
their own; repeated rows are judged row by row; an empty table gives an empty result; input columns
named like a measure are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
IQRS = 6
#: Measures under adaptive thresholds, with the least distance from the quartiles that counts as far.
SLACK = {"symbol_permille": 30, "dup_line_permille": 350, "repeat_permille": 280, "word_length_x100": 150}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Groups (language and source) whose thresholds are broadcast: under 100 bytes each, 10 MB at most; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 100_000


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that lie in a window found twice or more; first occurrences count."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), s - F.get(starts, k - 1))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        found = let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, j: ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["k"],
                )
            ),
        )
        return let(found, covered)

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(each) - window), lambda k: F.xxhash64(*[F.get(each, k + i) for i in range(window)]))

    by_window = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda each: let(windows(each), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(repeats(h))),
    )
    return F.when(F.size(words) >= window, by_window).otherwise(F.lit(0).cast("bigint"))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the five counts of COUNTS, n_lines and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    symbols, blanks = "#*$%&|<>", " \t\n\u000b\f\r"
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    n_chars = F.length(text)
    made = {
        "n_words": F.col("__w.n_words"),
        "word_chars": F.length(F.translate(text, blanks, "")).cast("bigint"),
        "n_symbols": (n_chars - F.length(F.translate(text, symbols, ""))).cast("bigint"),
        "n_dup_lines": F.col("__l.n_dup_lines"),
        "n_repeat_words": F.col("__w.n_repeat_words"),
        "n_lines": F.col("__l.n_lines"),
    }
    out = df.withColumns({"__w": of_words, "__l": of_lines}).withColumns(made).drop("__w", "__l")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def ratio(top: str, bottom: str, by: int) -> Column:
    return F.expr(f"{by} * {top} div greatest({bottom}, 1)")


RATIOS = {
    "symbol_permille": ("n_symbols", "word_chars", 1000),
    "dup_line_permille": ("n_dup_lines", "n_lines", 1000),
    "repeat_permille": ("n_repeat_words", "n_words", 1000),
    "word_length_x100": ("word_chars", "n_words", 100),
}


def bucket(name: str) -> Column:
    """Bucket of a value of 0 or more: the value itself below 64, then 32 buckets for each doubling."""
    shift = f"greatest(length(bin({name})) - 6, 0)"
    return F.expr(f"{shift} * 32 + shiftright({name}, {shift})")


def bucket_top(name: str) -> Column:
    """The largest value in a bucket."""
    shift = f"CAST(greatest(({name} - 32) div 32, 0) AS INT)"
    return F.expr(f"CASE WHEN {name} < 64 THEN {name} ELSE shiftleft({name} - {shift} * 32 + 1, {shift}) - 1 END")


def sketches(measured: DataFrame, group: list[str]) -> DataFrame:
    """(group..., measure, bucket, n): one sketch for each group and measure."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in SLACK])).alias("x")
    long = measured.where(~F.col("base_failed")).select(*group, each).select(*group, "x.measure", "x.value")
    return long.groupBy(*group, "measure", bucket("value").cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(parts: DataFrame, group: list[str]) -> DataFrame:
    """Several sketches of a group as one."""
    return parts.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, group: list[str], iqrs: int = IQRS) -> DataFrame:
    """(group..., low_<measure>, high_<measure>): the fences of each group. A sketch has some hundred buckets, whatever it has counted."""
    own = Window.partitionBy(*group, "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.sum("n").over(own))
    quartile = lambda m, q: F.min(F.when((F.col("measure") == m) & (4 * F.col("upto") >= q * F.col("of")), bucket_top("bucket")))
    fences = ranked.groupBy(*group).agg(*[quartile(m, q).alias(f"q{q}_{m}") for m in SLACK for q in (1, 3)])
    out = []
    for m, slack in SLACK.items():
        reach = F.greatest(iqrs * (F.col(f"q3_{m}") - F.col(f"q1_{m}")), F.lit(slack))
        out += [(F.col(f"q1_{m}") - reach).alias(f"low_{m}"), (F.col(f"q3_{m}") + reach).alias(f"high_{m}")]
    return fences.select(*group, *out)


def judge(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``df`` with the counts, base_failed and kept.

    The measures are written once to the shared folder; the thresholds are read from there too, and
    broadcast only if their counted number of groups is within BROADCAST_GROUPS.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    group = ["__lang", "__source"]
    drop = {*COUNTS, *SLACK, "n_lines", "base_failed", "kept"}
    keep = [c for c in keep if c not in drop]
    needed = list(dict.fromkeys([*keep, text_col]))
    measured = measure(df.select(*needed, F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source")), text_col)
    measured = measured.select(*keep, *group, *COUNTS, "n_lines", "base_failed", *[ratio(*r).cast("bigint").alias(m) for m, r in RATIOS.items()])
    measured = materialize(measured, "measures")
    fences = materialize(thresholds(sketches(measured, group), group), "fences")
    small = fences.count() <= BROADCAST_GROUPS
    joined = measured.alias("m").join(
        (F.broadcast(fences) if small else fences).alias("f"),
        F.col("m.__lang").eqNullSafe(F.col("f.__lang")) & F.col("m.__source").eqNullSafe(F.col("f.__source")),
        "left",
    )
    usual = F.lit(True)
    for m in SLACK:
        usual = usual & F.col(f"m.{m}").between(F.col(f"f.low_{m}"), F.col(f"f.high_{m}"))
    return joined.select(*[F.col(f"m.{c}") for c in [*keep, *COUNTS, "n_lines", "base_failed", *SLACK]], (~F.col("m.base_failed") & F.coalesce(usual, F.lit(False))).alias("kept"))

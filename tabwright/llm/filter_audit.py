"""What each filter of a chain removes in every order of the chain, from one count for each set of failed filters.

Hart and Mas-Colell: the removal game of a coalition S of filters is v(S), the documents that fail a filter of S.
Its potential is P({}) = 0 and P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, built up over all
coalitions from the small ones; a filter's Shapley value is P(all) - P(all without it). Kept as |S|! P(S), every
potential is a whole number, so nothing is rounded. What a step of an order removes is v with the filter less v
without it, for all documents as for the good and the toxic ones.

Documents are read once, for their set of failed filters. Identity of texts is decided by SHA-256: rows are counted
by (text, id), then by (text, part, label) before rows of one text meet, so a text with a third of all rows costs
one row for each task, and no more than one for each part and label afterwards. Everything after that works on at
most 2^k rows of each part, whatever the size of the table.

Defined cases: a null text is empty (no words, no code points); a null part is the empty string; a null id has no
smaller one and is none, so such a row is never a copy and has no label; several labels of one id count as good or
toxic if one of them does; repeated rows (same id and text) are no copies of each other and count one by one; a
very long text is handled whole, as one row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
#: The filters on a text alone; COPY follows them.
TEXT_FILTERS = ("A", "B", "C", "D")
COPY = "E"


def text_failures(text: Column) -> Column:
    """The set of failed text filters as bits: too short, repetitive, loud, symbols."""
    words = F.array_remove(F.split(text, SPACES), "")
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]

    def bits(c: Column) -> Column:
        fails = [
            c["n"] < MIN_WORDS,
            100 * c["d"].cast("bigint") < MIN_DISTINCT_PCT * c["n"].cast("bigint"),
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > MAX_CAPITALS_PCT * F.length(text).cast("bigint"),
            text.rlike(SYMBOLS),
        ]
        return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))

    return F.transform(F.array(counted), bits)[0]


def failed_sets(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic"
) -> DataFrame:
    """(part, failed, n, good, toxic): how many documents of a part fail exactly the filters in the bits of ``failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_failures(text).alias("failed")
    )
    rows = own.groupBy("id", "part", "same", "failed").agg(F.count(F.lit(1)).alias("n"))
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    named = named.agg(F.max((F.col(quality_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    rows = rows.join(named, "id", "left").na.fill(0, ["good", "toxic"])
    # For each text, part and label: rows in all, without id, and with the least id of this group.
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("nameless")
    alike = rows.groupBy("same", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), nameless, first)
    least = F.min("least.id").over(Window.partitionBy("same"))
    alike = alike.withColumn("first", F.when(F.col("least.id") == least, F.col("least.n")).otherwise(F.lit(0)))
    n, copies = F.col("n"), F.col("n") - F.col("nameless") - F.col("first")
    split = F.explode(F.array(F.struct(F.col("failed").alias("f"), (n - copies).alias("n")), F.struct((F.col("failed") + (1 << len(TEXT_FILTERS))).alias("f"), copies.alias("n"))))
    flat = alike.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", F.col("x.f").alias("failed"), F.col("x.n").alias("n")).where("n > 0")
    counted = flat.groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return materialize(counted, "failed-sets")


def coalitions(sets: DataFrame, filters: int) -> DataFrame:
    """One row for each part: total, and for each coalition the documents, good and toxic ones that fail one of its filters; ``exact``: those that fail just it."""
    hit = lambda of, s: F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, F.col(of)).otherwise(F.lit(0)))
    every = range(1 << filters)
    return sets.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.array(*[hit(of, s) for s in every]).alias(name) for of, name in (("n", "v"), ("good", "v_good"), ("toxic", "v_toxic"))],
    )


def potentials(values: DataFrame, filters: int) -> DataFrame:
    """``values`` with ``potential``: |S|! P(S) of the removal game for each coalition S, each from the ones with a filter less."""
    by_size: dict[int, list[int]] = {}
    for s in range(1, 1 << filters):
        by_size.setdefault(s.bit_count(), []).append(s)
    out = values.withColumn("__p0", F.lit(0).cast("bigint"))
    for size, some in sorted(by_size.items()):
        out = out.withColumns({f"__p{s}": F.lit(factorial(size - 1)) * F.get("v", F.lit(s)) + sum(F.col(f"__p{s & ~(1 << i)}") for i in range(filters) if s >> i & 1) for s in some})
    return out.withColumn("potential", F.array(*[F.col(f"__p{s}") for s in range(1 << filters)])).select(*values.columns, "potential")


def audit(sets: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters in ``names``.

    ``shapley`` is what the step's filter removes, summed over all orders: its Shapley value times their number.
    """
    k = len(names)
    full = (1 << k) - 1
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(f"{''.join(names[i] for i in order)},{step},{f},{before}")
            before |= 1 << f
    fixed = F.explode(F.transform(F.split(F.lit(";".join(steps)), ";"), lambda x: F.split(x, ",")))
    each = potentials(coalitions(sets, k), k).withColumn("x", fixed)
    each = each.select("*", F.col("x")[0].alias("filter_order"), *[F.col("x")[i].cast("int").alias(c) for i, c in ((1, "step"), (2, "f"), (3, "before"))])
    own = F.expr("shiftleft(1, f)")
    after = F.col("before").bitwiseOR(own)
    at = lambda game, s: F.get(game, s)
    gain = lambda game: at(game, after) - at(game, F.col("before"))
    rest = F.lit(full).bitwiseXOR(own)
    return each.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("v", after)).alias("kept"),
        gain("v").alias("removed"),
        (at("v", own) - gain("v")).alias("redundant"),
        (at("v", F.lit(full)) - at("v", rest)).alias("unique_fails"),
        gain("v_good").alias("good_lost"),
        gain("v_toxic").alias("toxic_lost"),
        (at("potential", F.lit(full)) - k * at("potential", rest)).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``audit`` of the five filters A to E over whole documents."""
    return audit(failed_sets(docs, labels, **columns), "".join(TEXT_FILTERS) + COPY)

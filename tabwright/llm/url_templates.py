"""URL filters from a tree of path templates for each host, with DataFrame functions only.

1. A list of rules (host, path, verdict) judges the URLs that it fits; these verdicts are the labels for the rest.
2. Segments with a digit are variable by form. This alone turns the paths of a host into far fewer shapes; shapes are
   counted (all, blocked and allowed URLs) and everything up to the verdicts works on these counts, so a host with a
   third of all rows costs one row for each task and shape.
3. The shapes of a host are a tree. A branch is variable by count if its parent has more than ``FANOUT`` branches and
   it holds under one in ``FANOUT`` of the parent's URLs; it becomes a wildcard.
4. Siblings that keep their names (at most ``FANOUT`` of a parent) are ordered by the shares of their URLs that
   are blocked, allowed and at their last segment. A branch is merged with the one before it if all three shares lie
   within the Hoeffding distance of the two; no pairs are made.
5. The URLs of one template share their labels. Its purity is the smoothed share of blocked ones,
   (blocked + SMOOTHING * q) / (labelled + SMOOTHING), where q is the share of blocked URLs among all labelled ones;
   templates of ``REJECT`` and more are rejected, and with them their URLs that no rule fits.

A branch is known by its host, its depth and the exclusive or of the hashes of (depth, segment) down to it (64 bits).
Only rejected shapes are joined back to the URLs; they are counted before they are broadcast, else they are shuffled.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule fits it, and all of those are one
template; empty segments are skipped, but a slash at the end is a segment of its own; a segment that is ``*`` or ``~``
counts as variable or merged; a very long path costs one small row for each segment of its shape; repeated rows count
as often as they are there; without labels nothing is rejected; an empty table gives an empty result; input columns
named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

#: (host, path, verdict) as the query uses them.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Branches of a parent beyond which its small ones are variable; one in as many of its URLs makes a branch small.
FANOUT = 50
#: ln(2 / 0.05) / 2: shares of n URLs lie within sqrt(CONFIDENCE / n) of the true ones in 95 of 100 cases.
CONFIDENCE = 1.844
SMOOTHING, REJECT = 8, 0.8
#: Rejected shapes that are broadcast, of under 100 bytes each; beyond it they are joined by shuffle.
BROADCAST_SHAPES = 100_000
VARIABLE, MERGED, SLASH = "*", "~", "/"
OUT = ("host", "path", "rule", "verdict")
#: What a branch and its siblings are compared by.
SHARES = ("blocked", "allowed", "ends")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parsed(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring("__rest", F.length("__raw") + 1, F.length("__rest")), r"^[^?#]*", 0)
    named = df.withColumn("__rest", rest).withColumn("__raw", raw)
    return named.withColumns({"path": path, "host": F.translate("__raw", _UPPER, _UPPER.lower())}).drop("__rest", "__raw")


def rule_of(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null where none does. Of equally long ones the first in order of text counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The segments of a path in order, those that are variable by form as a wildcard."""
    parts = F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.when(s.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(s))
    return F.when(path.endswith("/"), F.concat(parts, F.array(F.lit(SLASH)))).otherwise(parts)


def shape_key(host: Column, shape: Column) -> Column:
    """Names a shape of a host; neither hosts nor segments hold a slash."""
    return F.sha2(F.concat(host, F.lit("/"), F.array_join(shape, "/")), 256)


def branches(shapes: DataFrame) -> DataFrame:
    """A row for each shape and segment: depth (from 1), segment, node, parent, and whether the shape ends there."""
    down = Window.partitionBy("key").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    each = shapes.select("key", "host", "n", "blocked", "allowed", F.size("shape").alias("deep"), F.posexplode("shape").alias("depth", "segment"))
    own = F.xxhash64("depth", "segment")
    return each.withColumn("node", F.bit_xor(own).over(down)).withColumn("parent", F.col("node").bitwiseXOR(own)).withColumn("last", F.col("depth") == F.col("deep") - 1).drop("deep")


def branch_names(each: DataFrame) -> DataFrame:
    """(host, depth, node, called): what each branch is called in a template, which is itself, variable or merged."""
    ends = F.sum(F.when(F.col("last"), F.col("n")).otherwise(F.lit(0)))
    nodes = each.groupBy("host", "depth", "parent", "node", "segment").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), ends.alias("ends"))
    nodes = materialize(nodes, "url-nodes")
    parent = ["host", "depth", "parent"]
    held = nodes.join(nodes.groupBy(*parent).agg(F.count(F.lit(1)).alias("siblings"), F.sum("n").alias("all_n")), parent)
    small = (F.col("siblings") > FANOUT) & (F.col("n") * FANOUT < F.col("all_n"))
    variable = held.withColumn("called", F.when(F.col("segment").isin(VARIABLE, SLASH), F.col("segment")).when(small, F.lit(VARIABLE)))
    variable = materialize(variable, "url-siblings")
    order = Window.partitionBy(*parent).orderBy(*[F.col(c) / F.col("n") for c in SHARES], "segment")
    before = lambda c: F.lag(c).over(order)
    reach = F.sqrt(F.lit(CONFIDENCE) / F.col("n")) + F.sqrt(F.lit(CONFIDENCE) / before("n"))
    apart = F.lit(False)
    for c in SHARES:
        apart = apart | (F.abs(F.col(c) / F.col("n") - before(c) / before("n")) > reach)
    named = variable.where("called IS NULL").withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    named = named.withColumn("group", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*parent, "group"))
    named = named.withColumn("called", F.when(size > 1, F.concat(F.lit(MERGED), F.col("group").cast("string"))).otherwise(F.col("segment")))
    out = ["host", "depth", "node", "called"]
    return variable.where("called IS NOT NULL").select(*out).unionAll(named.select(*out))


def templates(shapes: DataFrame) -> DataFrame:
    """(key, host, template, blocked, allowed) for shapes (key, host, shape, n, blocked, allowed)."""
    each = materialize(branches(shapes), "url-branches")
    named = each.join(branch_names(each), ["host", "depth", "node"])
    template = F.transform(F.array_sort(F.collect_list(F.struct("depth", "called"))), lambda x: x["called"])
    deep = named.groupBy("key").agg(template.alias("template"))
    joined = shapes.join(deep, "key", "left")
    return joined.select("key", "host", F.coalesce("template", F.array().cast("array<string>")).alias("template"), "blocked", "allowed")


def purities(known: DataFrame) -> DataFrame:
    """(host, template, purity): the smoothed share of blocked URLs among the labelled ones."""
    labelled = F.col("blocked") + F.col("allowed")
    total = known.agg(F.sum("blocked").alias("blocked"), F.sum(labelled).alias("labelled")).first()
    prior = SMOOTHING * (total.blocked / total.labelled if total.labelled else 0.0)
    by = known.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    return by.select("host", "template", ((F.col("blocked") + F.lit(prior)) / (labelled + SMOOTHING)).alias("purity"))


def judge_urls(df: DataFrame, rules=RULES, url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``df`` with host, path, rule and verdict (allow or block)."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in OUT]
    urls = parsed(df.select(*keep, F.col(url_col).alias("__url")), "__url").withColumn("__shape", segments(F.col("path")))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    urls = urls.withColumns({"rule": rule, "__verdict": verdict, "__key": shape_key(F.col("host"), F.col("__shape"))})
    count = lambda v: F.count(F.when(F.col("__verdict") == v, F.lit(1)))
    counted = urls.groupBy(F.col("__key").alias("key"), "host", F.col("__shape").alias("shape")).agg(F.count(F.lit(1)).alias("n"), count("block").alias("blocked"), count("allow").alias("allowed"))
    known = materialize(templates(materialize(counted, "url-shapes")), "url-templates")
    bad = known.join(purities(known).where(F.col("purity") >= REJECT), ["host", "template"], "left_semi").select(F.col("key").alias("__bad"))
    bad = materialize(bad, "url-rejected")
    small = bad.count() <= BROADCAST_SHAPES
    joined = urls.join(F.broadcast(bad) if small else bad, F.col("__key") == F.col("__bad"), "left")
    own = F.when(F.col("__bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(*keep, "host", "path", "rule", F.coalesce("__verdict", own).alias("verdict"))

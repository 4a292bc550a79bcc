"""Preference formatting: the common turns of two conversations once as prompt, then paired masked completions.

One row for each pair holds the prompt, the chosen and the rejected completion, and the spans of each completion
that a model is trained on: the text of every answer up to and with its end mark. The header of an answer, all
turns of others and the whole prompt are masked. The first turn that differs, a minimum for each pair, ends the
prompt.

A pair is worked on in pieces of ``PIECE`` turns, counted from its first turn, so a conversation with a third of all
turns is spread like any other and no task gathers more than a piece. Ordinary conversations are one piece; the pieces
of a longer one are numbered, and their columns put one behind the other in that order are the whole (spans
count from the start of their own piece). Texts are shuffled to (pair, turn) once to drop repeats and to (pair,
piece) once to be put together; what goes by pair alone is one row of two numbers for each piece.

Defined cases: null roles and texts are empty; rows with a null pair or turn are left out; of several rows for one
turn the least by role and text counts (repeated rows are one); conversations that are equal are all prompt and have
two empty completions; a conversation that ends first, or is not there at all, gives an empty completion; an empty
table gives an empty result; very long texts stay whole; further columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ANSWERS = "assistant"
TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")
PIECE = 1024
SPANS = "array<struct<begin:bigint,end:bigint>>"


def _side(df: DataFrame, side: str, other: str, pair: str, turn: str, role: str, text: str) -> DataFrame:
    own = F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    none = F.lit(None).cast("struct<role:string,text:string>")
    kept = df.where(F.col(pair).isNotNull() & F.col(turn).isNotNull())
    return kept.select(F.col(pair).alias("pair"), F.col(turn).cast("bigint").alias("turn"), own.alias(side), none.alias(other)).select("pair", "turn", "a", "b")


def _completion(turns: Column) -> Column:
    """(text, spans) of rendered turns in order."""
    begin, middle, end = TEMPLATE
    header = lambda x: F.concat(F.lit(begin), x["role"], F.lit(middle))
    rendered = F.array_join(F.transform(turns, lambda x: F.concat(header(x), x["text"], F.lit(end))), "")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(header(x))
        stop = start + F.length(x["text"]) + len(end.rstrip("\n"))
        own = F.array(F.struct(start.cast("bigint").alias("begin"), stop.cast("bigint").alias("end")))
        spans = F.when(x["role"] == ANSWERS, F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct((start + F.length(x["text"]) + len(end)).cast("bigint").alias("at"), spans.alias("spans"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.struct(rendered.alias("text"), F.aggregate(turns, first, step, lambda acc: acc["spans"]).alias("spans"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(pair, piece, prompt, chosen, rejected, prompt_turns, chosen_spans, rejected_spans), one row for each piece of a pair."""
    columns = (pair, turn, role, text)
    rows = _side(chosen, "a", "b", *columns).unionAll(_side(rejected, "b", "a", *columns))
    # Blocks of turn numbers, floored, so that negative ones lie in order too.
    block = F.expr(f"(turn - pmod(turn, {piece}L)) div {piece}L")
    turns = rows.groupBy("pair", "turn").agg(F.min("a").alias("a"), F.min("b").alias("b")).withColumn("block", block)
    differs = F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("turn"))
    blocks = turns.groupBy("pair", "block").agg(F.min(differs).alias("fork"))
    pairs = blocks.groupBy("pair").agg(F.min("fork").alias("fork"), F.min("block").alias("lowest"))
    placed = blocks.select("pair", "block").join(pairs, "pair")
    item = F.struct("turn", "a", "b")
    pieces = turns.groupBy("pair", "block").agg(F.sort_array(F.collect_list(item)).alias("all")).join(placed, ["pair", "block"])
    common = lambda x: F.coalesce(x["turn"] < F.col("fork"), F.lit(True))
    after = F.filter("all", lambda x: ~common(x))
    of = lambda side: F.transform(F.filter(after, lambda x: x[side].isNotNull()), lambda x: x[side])
    shared = F.transform(F.filter("all", common), lambda x: x["a"])
    made = pieces.select("pair", (F.col("block") - F.col("lowest")).alias("piece"), shared.alias("p"), of("a").alias("c"), of("b").alias("r"))
    done = made.select("pair", "piece", F.size("p").cast("bigint").alias("prompt_turns"), _completion(F.col("p"))["text"].alias("prompt"), _completion(F.col("c")).alias("c"), _completion(F.col("r")).alias("r"))
    return done.select(
        F.col("pair").alias(pair), "piece", "prompt", F.col("c.text").alias("chosen"), F.col("r.text").alias("rejected"), "prompt_turns", F.col("c.spans").alias("chosen_spans"), F.col("r.spans").alias("rejected_spans")
    )


def worse_copies(conversations: DataFrame, kinds: int = 5) -> DataFrame:
    """Rejected sides for a table that holds none, of one kind for each conversation, by its id.

    0: the last answer is broken off half-way; 1: the first one is, so that the pair forks early; 2: the conversation
    stops before its last answer, so that nothing is rejected; 3: an answer more follows; 4: there is no rejected side.
    """
    answers = conversations.where(F.col("role") == ANSWERS).groupBy("conv_id").agg(F.min("turn").alias("__first"), F.max("turn").alias("__last"))
    kind = F.pmod(F.col("conv_id"), F.lit(kinds))
    half = F.expr("substring(text, 1, length(text) div 2)")
    hit = (F.col("role") == ANSWERS) & (((kind == 0) & (F.col("turn") == F.col("__last"))) | ((kind == 1) & (F.col("turn") == F.col("__first"))))
    kept = (kind < 4) & ((kind != 2) | F.col("__last").isNull() | (F.col("turn") < F.col("__last")))
    changed = conversations.join(answers, "conv_id", "left").where(kept).withColumn("text", F.when(hit, half).otherwise(F.col("text"))).select("conv_id", "turn", "role", "text")
    more = conversations.where(kind == 3).groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    return changed.unionByName(more.select("conv_id", "turn", F.lit(ANSWERS).alias("role"), F.lit("...").alias("text")))

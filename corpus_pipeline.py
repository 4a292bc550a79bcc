"""The corpus pipeline: quality rules, near-duplicate removal, masking of personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. Copies are removed by row: rows of one id with texts that nothing links all stay, rows with a null
id come last in their group, rows with the same id and text are one, and texts without words are nobody's copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.llm import bpe, jaccard_join, mixing, pii, quality
from tabwright.llm.queries import tokenizer_path
from tabwright.registry.base import Query, table
from tabwright.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs, keep=docs.columns).where("kept").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that n-gram similarity links: the one with the least id."""
    own = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("__row", own)
    groups = jaccard_join.join_similar(keyed.select(F.col("__row").alias("doc_id"), "text")).where("n_shingles > 0")
    groups = materialize(groups.groupBy(F.col("doc_id").alias("__row"), "component_id").agg(F.count(F.lit(1)).alias("n")), "groups")
    ids = keyed.select("__row", "doc_id").distinct()
    first = groups.join(ids, "__row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__row")).alias("first"))
    fate = groups.join(first, "component_id").select("__row", "n", (F.col("first.__row") == F.col("__row")).alias("stays"))
    listed = materialize(fate.where("n > 1 OR NOT stays"), "copies")
    alone = keyed.join(listed, "__row", "left_anti")
    repeated = keyed.join(listed.where("stays"), "__row", "left_semi").dropDuplicates(["__row"])
    return alone.select(*docs.columns).unionAll(repeated.select(*docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    masked = pii.redact(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one on a source's border with the words that are missing."""
    taken = mixing.write_out(mixing.mix(docs))
    return taken.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): packed ids, and whether they decode to the text."""
    names = ["doc_id", "lang", "source"]
    text = docs.select(*names, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    back = bpe.encode_and_decode(text, tokenizer_path(), keep=[*names, "sha"])
    return back.select(*names, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("personal data", pii_stage),
    ("mix sources", mix_stage),
    ("BPE round trip", bpe_stage),
]
#: Masking and BPE are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k + 1}")
    return docs


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}

"""A corpus from raw documents to packed windows, in five stages.

Each stage takes all that the one before it kept, is written as Parquet and read again; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.common import table, written
from steploom.llm.jaccard import jaccard_components
from steploom.llm.line_dedup import drop_common_lines
from steploom.llm.mixing import mixed_documents
from steploom.llm.packing import pack
from steploom.llm.quality import good_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the calibrated cutoffs go."""
    return good_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more leave them all; a document without a word left goes."""
    out = drop_common_lines(docs.select(*COLUMNS), min_docs=10)
    out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.where((F.col("_n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: its component's least id.

    A document is a distinct pair of id and text: different texts under one id, or under none, are
    compared as documents of their own, and rows that repeat a pair are one document.
    """
    docs = _keyed(docs.select(*COLUMNS))
    found = jaccard_components(docs, k=5, num=80, den=100, id_col="_key")
    kept = found.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("_key"))
    return docs.join(kept, "_key", "left_semi").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """One row a document, with ``_key``: its id, or a number over all ids where the id is null or another text has it."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_odd"))
    odd = written(odd, "odd-ids")
    if odd.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_odd"))
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    hashed = docs.join(odd, same, "left_semi").withColumn("_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    texts = hashed.groupBy("doc_id", "_hash").agg(F.min(F.struct("text", *rest)).alias("_row"))
    over = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0).cast("long"))).first()[0] + 1
    texts = written(texts.select("doc_id", "_hash", "_row.*", (F.monotonically_increasing_id() + F.lit(over)).alias("_over")), "odd-texts")
    least = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_hash").alias("_least"))
    key = F.when(F.col("_hash") == F.col("_least"), F.col("doc_id")).otherwise(F.col("_over"))
    texts = texts.join(least, "doc_id", "left").select(*COLUMNS, key.alias("_key"))
    return docs.join(odd, same, "left_anti").withColumn("_key", F.col("doc_id")).unionByName(texts)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3; each document stands as often as the mix takes it."""
    return mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenizers and near duplicates are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is that of the last."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs

"""The corpus pipeline: from raw documents to packed training sequences.

Each stage reads what its predecessor kept, written as Parquet, and calls one operator of assayer.llm. All
but the last return the columns of documents. A stage that drops rows numbers them first and names what it
drops by these numbers, so that null and repeated doc_ids are rows of their own. An empty table gives no
rows; very long texts are read whole; further columns are kept, but one named _row is not allowed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import common, exact_dedup, language_id, ngram_jaccard, packing, secrets


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; those that language ID rejects go."""
    rows = common.numbered(docs)
    found = language_id.identify_documents(rows.withColumn("doc_id", F.col("_row")))
    return common.without(rows, found.where("rejected").select(F.col("doc_id").alias("_row")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, of those the one with the smallest doc_id."""
    rows = common.numbered(docs)
    found = exact_dedup.dedup(rows, row="_row")
    return common.without(rows, found.where("NOT kept").select(F.col("rid").alias("_row")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies; a null doc_id comes after all others."""
    rows = common.numbered(docs)
    found = ngram_jaccard.link(rows.withColumn("doc_id", F.col("_row"))).select(F.col("doc_id").alias("_row"), "component_id")
    found = common.written(found.join(rows.select("_row", "doc_id"), "_row"), "near-copies")
    first = found.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("first"))
    stays = common.written(first.where("n > 1").select("component_id", "n", F.col("first._row").alias("stays")), "near-first")
    total = stays.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return common.without(rows, common.join_hot(found, stays, ["component_id"], "n", total).where("_row <> stays"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of equal length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", jaccard_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Language likelihoods, Jaccard components and token ids are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

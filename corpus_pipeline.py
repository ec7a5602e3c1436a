"""The training-data pipeline: quality, near copies, mixture, packing, each stage over what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.llm import mixing, ngram_join, packing, quality
from sitefacts.llm.common import table
from sitefacts.sources.storage import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, fitted on the labelled ones among them."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs.withColumnRenamed("score", "__score"), model).filter("score >= 0.5")
    return scored.select(*[F.col("__score").alias("score") if c == "score" else c for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles (five words, similarity 0.8), the one with the smallest doc_id.

    Rows that repeat a doc_id are one document: one of them stays, that with the smallest hash of its
    text. Rows with a null doc_id stay.
    """
    groups = ngram_join.classes(docs.select("doc_id", "text"), size=5, percent=80)
    dropped = groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(dropped, F.col("doc_id") == F.col("__id"), "left_anti")
    repeated = kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("first"))
    repeated = staged(repeated.filter("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), "first"), "repeated")
    if repeated.isEmpty():
        return kept
    met = kept.join(repeated, F.col("doc_id") == F.col("__id"), "left")
    alone = met.filter("__id IS NULL").select(*docs.columns)
    several = met.filter(F.col("first") == F.xxhash64("text")).select(*docs.columns).dropDuplicates(["doc_id"])
    return alone.unionByName(several)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents.

    A document of which the mix takes half or more of a pass counts as taken in that pass. Documents
    without words have no weight in the mix and stay once.
    """
    taken = mixing.mix(docs.select("doc_id", "source", "text"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    taken = taken.groupBy("doc_id").agg(F.max(times).alias("__times")).withColumnRenamed("doc_id", "__id")
    met = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id"))).filter("__times > 0")
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_copies", one_of_each_group),
    ("mixture", mixed_documents),
    ("packing", packed_sequences),
]

#: Neither the classifier nor the tokenizer can be stated in SQL; tests check each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

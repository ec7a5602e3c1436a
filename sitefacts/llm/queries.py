"""One query per operator over its whole table; ``ORACLES`` states those again that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.llm import (
    chat, collocations, embedding_dedup, fingerprints, html_extract, mixing, neighbours, ngram_join, packing, quality,
    token_counts, warc, whitening,
)
from sitefacts.llm.common import table
from sitefacts.sources.storage import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    path = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.archive_pages(table(spark, sf_dir, "pages"), path)
    records = warc.resolve_revisits(warc.read_archives(spark, path, with_payload=False))

    def page(c: str):
        return F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by word shingles."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every fiftieth row."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all vectors."""
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no quotes, so its messages first become mails that quote each other."""
    mails = chat.as_mails(table(spark, sf_dir, "conversations"))
    return chat.chats(mails)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector."""
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of each language over all texts."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited text and their likeness."""
    return fingerprints.edit_study(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op6_neighbours": op6_neighbours,
    "op7_token_counts": op7_token_counts,
    "op8_html_extract": op8_html_extract,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES: dict[str, str] = {"op4_mixing": mixing.ORACLE, "op10_chat": chat.ORACLE, "op12_collocations": collocations.ORACLE}

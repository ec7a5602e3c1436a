"""Record sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD_SECTIONS = (
    "identity", "business_summary", "evidence_proof_signals", "contact_location",
    "team_hiring_signals", "metadata",
)


def _with_iso_time(records: DataFrame) -> DataFrame:
    """Timestamp in its text form, UTC with a trailing ``Z`` (the session time zone must be UTC)."""
    stamp = F.date_format("metadata.timestamp_of_scrape", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return records.withColumn(
        "metadata", F.col("metadata").withField("timestamp_of_scrape", stamp)
    )


def record_json(records: DataFrame, pretty: bool = False) -> DataFrame:
    """``site`` and the record as JSON text, every key present."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    body: Column = F.to_json(F.struct(*RECORD_SECTIONS), options)
    return _with_iso_time(records).select("site", body.alias("json"))


def write_records(records: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write records as ``parquet`` or as ``json`` (one object per line, UTF-8, nulls kept)."""
    if fmt == "json":
        out = _with_iso_time(records).select("site", *RECORD_SECTIONS)
        out.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        records.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")

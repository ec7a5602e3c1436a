"""Pages that arrive over time.

Two ways to keep records up to date. ``start_facts_stream`` writes the facts of each micro-batch to
folders, and ``refresh_records`` reads those of the touched sites again. ``start_winner_stream`` keeps
the counting copy of every URL in a state store instead, and logs which changed; ``refresh_touched``
then reads the store and the log's new folders, and no batch a second time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sitefacts.config import ExtractConfig
from sitefacts.plans.company import corpus_facts, records_from_facts
from sitefacts.sources.pages import PAGE_SCHEMA

DEFAULT = ExtractConfig()

# Send this module's code along with the tasks: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def start_facts_stream(
    pages: DataFrame, facts_path: str, checkpoint: str, cfg: ExtractConfig = DEFAULT
) -> StreamingQuery:
    """Extract every available page of a page stream into ``facts_path/batch=<n>``.

    A page's facts need no other page, so there is no state to keep. A repeated batch overwrites its
    own folder, which makes the sink idempotent.
    """

    def write(batch: DataFrame, number: int) -> None:
        corpus_facts(batch, cfg).write.mode("overwrite").parquet(f"{facts_path}/batch={number}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refresh_records(
    spark: SparkSession,
    facts_path: str,
    seeds: DataFrame,
    since_batch: int = 0,
    crawl_ts: datetime = datetime(1970, 1, 1),
    cfg: ExtractConfig = DEFAULT,
) -> DataFrame:
    """Records of the sites that got pages in ``since_batch`` or later, from all their facts so far.

    ``batch`` is a partition column, so finding the touched sites reads the new folders only.
    """
    facts = spark.read.parquet(facts_path)
    touched = facts.filter(F.col("batch") >= since_batch).select("site").distinct()
    return records_from_facts(
        facts.join(touched, "site", "left_semi"),
        seeds.join(touched, "site", "left_semi"),
        crawl_ts=crawl_ts,
        cfg=cfg,
    )


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Numbers travel as text: pandas would turn a missing one into a rounded float.
_WINNER = "page_id string, copy string, outcome string, note string, body string"


def _rank(page_id: str | None, copy: str | None, outcome: str, note: str | None) -> tuple:
    """The order of ``unique_pages``: nulls first."""
    number = [(v is not None, int(v) if v is not None else 0) for v in (page_id, copy)]
    return (*number, outcome or "", note is not None, (note or "").encode())


class WinnerProcessor(StatefulProcessor):
    """Counting copy of one URL; gives a row whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.winner = handle.getValueState("winner", _WINNER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = tuple(self.winner.get()) if self.winner.exists() else None
        best = held
        for batch in rows:
            for row in batch[["page_id", "copy", "outcome", "note", "body"]].itertuples(index=False):
                row = tuple(None if pd.isna(v) else v for v in row)
                if best is None or _rank(*row[:4]) < _rank(*best[:4]):
                    best = row
        if best != held:
            self.winner.update(best)
            yield pd.DataFrame({"site": [key[0]], "url": [key[1]]})

    def close(self) -> None:
        pass


def _one_copy_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best copy of each URL of an Arrow batch: a URL with any share of the rows shrinks before the shuffle."""
    for batch in batches:
        best: dict[tuple, int] = {}
        columns = {c: batch[c].to_pylist() for c in ("site", "url", "page_id", "copy", "outcome", "note")}
        ranks = [_rank(*v) for v in zip(columns["page_id"], columns["copy"], columns["outcome"], columns["note"], strict=True)]
        for i, key in enumerate(zip(columns["site"], columns["url"], strict=True)):
            if key not in best or ranks[i] < ranks[best[key]]:
                best[key] = i
        yield batch.take(pa.array(sorted(best.values()), pa.int64()))


def _facts_schema(spark: SparkSession, cfg: ExtractConfig):
    """Type of a facts row, from an empty corpus."""
    return corpus_facts(spark.createDataFrame([], PAGE_SCHEMA), cfg).schema


def start_winner_stream(
    pages: DataFrame, changes_path: str, checkpoint: str, cfg: ExtractConfig = DEFAULT
) -> StreamingQuery:
    """Keep the counting copy of every ``(site, url)`` of a page stream, facts included, in a state store.

    Late and repeated copies change the state only if they come before the one that counts, so any
    split of the pages into batches ends with the same state. ``changes_path/batch=<n>`` holds the
    URLs that changed in a batch; a repeated batch overwrites its own folder. State is spread by URL, not by
    site. The state store is RocksDB.
    """
    spark = pages.sparkSession
    facts = corpus_facts(pages, cfg)
    body = [c for c in facts.columns if c not in ("site", "url", "page_id", "copy", "outcome", "note")]
    rows = facts.select(
        "site", "url", F.col("page_id").cast("string"), F.col("copy").cast("string"), "outcome", "note",
        F.to_json(F.struct(*body)).alias("body"),
    )
    changed = (
        rows.mapInArrow(_one_copy_per_batch, rows.schema)
        .groupBy("site", "url")
        .transformWithStateInPandas(WinnerProcessor(), "site string, url string", "Update", "None")
    )

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes_path}/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query takes the settings of its start
    try:
        return (
            changed.writeStream.foreachBatch(log).outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)


def current_facts(spark: SparkSession, checkpoint: str, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """Facts of the counting copies, read from the state store after the last finished batch."""
    schema = _facts_schema(spark, cfg)
    fixed = ("site", "url", "page_id", "copy", "outcome", "note")
    body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in fixed)
    store = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "winner").load()
    rows = store.select("key.site", "key.url", "value.*").withColumn("b", F.from_json("body", body))
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("copy").cast("long").alias("copy"),
        "site", "url", "outcome", "note", "b.*",
    ).select(*schema.names)


def refresh_touched(
    spark: SparkSession,
    changes_path: str,
    checkpoint: str,
    seeds: DataFrame,
    since_batch: int = 0,
    crawl_ts: datetime = datetime(1970, 1, 1),
    cfg: ExtractConfig = DEFAULT,
) -> DataFrame:
    """Records of the sites whose pages changed in ``since_batch`` or later, from the state store alone."""
    changes = spark.read.parquet(changes_path)
    touched = changes.filter(F.col("batch") >= since_batch).select("site").distinct()
    facts = current_facts(spark, checkpoint, cfg)
    return records_from_facts(
        facts.join(touched, "site", "left_semi"), seeds.join(touched, "site", "left_semi"), crawl_ts=crawl_ts, cfg=cfg
    )

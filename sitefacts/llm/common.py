"""Small helpers that several operators share."""

from __future__ import annotations

import os
import shutil
import site
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.sources.storage import staged

#: Applications whose workers have been given the package.
_SHIPPED: set[str] = set()

#: Words are runs of anything but these ASCII white-space characters (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give Python workers this package where they can't import it: once per application, as an archive."""
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    application = spark.sparkContext.applicationId
    if application in _SHIPPED or root in {Path(p).resolve() for p in known if p}:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='sitefacts-')}/sitefacts", "zip", root, "sitefacts")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few at a time, so that what a function makes of them stays small beside them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class TwoGenerations(dict):
    """Cache of at most ``2 * size`` entries: when the young half is full, it becomes the old one."""

    def __init__(self, compute: Callable, size: int):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def block_cells(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Deal the members of every ``key`` to cells of at most about ``2 * block`` rows.

    A key with up to ``block`` rows is one cell. A larger one is cut into blocks by a hash of
    ``member`` and gets one cell for each pair of blocks, so that any two of its members meet in
    exactly one cell, or, if both are of one block, in each cell of that block; in the cell
    ``(i, i)`` among others. Adds ``cell_i`` and ``cell_j``. The sizes are counted first.
    """
    sizes = (
        rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > block)
        .select(F.col(key).alias("__key"), F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
    )
    dealt = rows.join(sizes, F.col(key) == F.col("__key"), "left").drop("__key")
    own = F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int")
    dealt = dealt.withColumn("__own", F.when(F.col("__blocks").isNull(), F.lit(0)).otherwise(own))
    others = F.when(F.col("__blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("__blocks") - 1)
    )
    dealt = dealt.withColumn("__other", F.explode(others))
    return dealt.select(
        *rows.columns,
        F.least("__own", "__other").alias("cell_i"),
        F.greatest("__own", "__other").alias("cell_j"),
        F.col("__own").alias("cell_own"),
    )


def running_totals(
    rows: DataFrame, key: str, part: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same ``key``, as column ``name``.

    ``part`` cuts each key into ordered parts, so a hot key is many window groups: totals of parts
    are summed first, and every row adds the total of its part's predecessors to its own.
    """
    from pyspark.sql import Window

    rows = rows.withColumn("__part", part).withColumn("__value", value)
    inside = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy(key, "__part").agg(F.sum("__value").alias("__total"))
        .select(
            F.col(key).alias("__key"), F.col("__part").alias("__part_of"),
            F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"),
        )
    )
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    joined = rows.join(parts, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__part_of")))
    return joined.withColumn(name, F.col("__before") + F.col("__inside")).drop(
        "__part", "__value", "__key", "__part_of", "__before", "__inside"
    )


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex over undirected ``edges (a, b)``: (id, component).

    Each round every vertex takes the smallest label next to it, then the label of its label; rounds
    go on until nothing changes. Labels are staged as Parquet each round, so lineage stays short and
    lost executors cost one round. Only vertices with an edge take part in the rounds.
    """
    both = staged(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges"
    )
    labels = staged(
        both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels"
    )
    while True:
        told = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "label")
        near = told.union(labels).groupBy("id").agg(F.min("label").alias("near"))
        hop = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        jumped = near.join(hop, "near").select("id", F.least("near", "far").alias("new"))
        step = staged(
            jumped.join(labels, "id").select("id", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")),
            "labels",
        )
        labels = step.select("id", "label")
        if step.filter("moved").isEmpty():
            break
    return vertices.join(labels, "id", "left").select(
        *vertices.columns, F.coalesce("label", "id").alias("component")
    )



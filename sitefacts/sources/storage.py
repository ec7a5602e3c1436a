"""Where intermediate tables go: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Staged folders by application, and the names of those that are catalog tables.
_STAGED: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session, from ``spark.checkpoint.dir``.

    Only a local master, whose tasks all see the driver's disk, gets a temporary folder where none is set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = Path(tempfile.mkdtemp(prefix="sitefacts-")).as_uri()
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back, so later readers prune columns and recompute nothing."""
    spark = df.sparkSession
    path = f"{folder or checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(
    df: DataFrame, name: str, keys: list[str], folder: str | None = None, buckets: int | None = None, dealt: bool = False
) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``keys`` and read it back.

    A join on ``keys`` then shuffles the other side only, as often as the table is joined. There are as many
    buckets as shuffle partitions, so the other side meets them without being cut anew. ``dealt``
    says that the rows come from an aggregation by ``keys``: each bucket is then one file already,
    else they are repartitioned first.
    """
    spark = df.sparkSession
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{folder or checkpoint_dir(spark)}/{table}"
    rows = df if dealt else df.repartition(number, *keys)
    rows.write.bucketBy(number, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    application = spark.sparkContext.applicationId
    _STAGED.setdefault(application, []).append(path)
    _TABLES.setdefault(application, []).append(table)
    return spark.table(table)


def forget(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark drop shuffle files that nothing refers to.

    For jobs of many rounds, whose early rounds would otherwise take up disk until the end.
    """
    for frame in frames:
        files = frame.inputFiles()
        if not files:
            continue
        spark = frame.sparkSession
        application, name = spark.sparkContext.applicationId, files[0].rsplit("/", 2)[1]
        if name in _TABLES.get(application, []):
            _TABLES[application].remove(name)
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in [p for p in _STAGED.get(application, []) if p.endswith(f"/{name}")]:
            _STAGED[application].remove(path)
            _delete(spark, path)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_staged(spark: SparkSession) -> int:
    """Delete what this application has staged so far; call it when its results are written.

    Returns the number of tables. Frames that still read a staged table fail afterwards.
    """
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan evenly when it has fewer files than the cluster has cores.

    A corpus of many files already splits well and is left alone; a single-row-group file would
    otherwise run every later stage in one task. Rows are dealt without a key, so many copies of one
    URL or id are no large task. The plan is only looked at, nothing runs. Streams stay as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def spread_tasks(df: DataFrame, waves: int = 4) -> int:
    """Number of tasks that gives every core ``waves`` of them."""
    return waves * df.sparkSession.sparkContext.defaultParallelism


def spread_rows(df: DataFrame, waves: int = 4) -> DataFrame:
    """Deal rows evenly to ``waves`` tasks a core, for rows that each grow a lot in the next step.

    Adaptive execution sizes tasks by the bytes that were shuffled; short rows that become long there
    would all end in a few tasks.
    """
    return df.repartition(spread_tasks(df, waves))

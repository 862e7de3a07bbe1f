"""Session helpers: where scratch tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows a side may have to be sent to every executor.
BROADCAST_ROWS = 200_000


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder: the session's ``spark.checkpoint.dir``.

    A cluster names a folder every executor can reach. Only a local master may
    leave it out (tests, a laptop): a fresh local folder is made and registered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = current or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by four tasks a core; Spark's own rule is a task for each of up to 10,000 folders."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(int(old), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def materialize(df: DataFrame, name: str = "stage", by: str | None = None, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later jobs and must be the same in all
    of them even if executors are lost in between. ``by`` splits the table into
    folders, so a filter on that column reads only what it names. ``options`` go
    to the writer.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.options(**options)
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast side if it proves small, else as it is.

    Meant for gene axes and models: at most ``max_rows + 1`` rows are fetched to
    find out, and a larger side is left to a shuffled join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))

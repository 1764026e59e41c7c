"""Cutting the lineage of iterations in a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(df: DataFrame) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = df.sparkSession.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    shared_dir(df)
    sc = df.sparkSession.sparkContext
    _remove_at_exit(sc, sc._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=True)


_folders: set[str] = set()


def _remove(jvm, configuration, folder: str) -> None:
    """Take away an application's tables as its driver ends."""
    with contextlib.suppress(Exception):  # the JVM may have gone before
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)


def _remove_at_exit(sc, folder: str) -> None:
    """An application's own folder goes when its driver ends."""
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), folder)


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder: pruned by column, and by the partitioning column's folders."""
    spark = df.sparkSession
    folder = f"{shared_dir(df).rstrip('/')}/strandline-{spark.sparkContext.applicationId}"
    _remove_at_exit(spark.sparkContext, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


#: Rows of (at most) a few short strings that may be broadcast: some 20 MB.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if its counted rows are few; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one only where none is set and all tasks run on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder; what is written there is removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(table)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What ends within it leaves no shuffle files: they would stay until the driver happens to collect its garbage.

    A query that still wanted them would make them again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as a checkpoint: what follows reads them, and no lost executor costs a recomputation."""
    shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, planned here


def stored(df: DataFrame) -> DataFrame:
    """As ``kept``, but as a compressed table, so later steps read only the columns they use. For rows with texts."""
    path = new_path(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

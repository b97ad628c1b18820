"""The folder that all executors share, and what is written there for a while."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_written: list[tuple] = []


@contextmanager
def small_batches(spark: SparkSession, most: int):
    """What runs meanwhile sends rows to Python in batches of about ``most`` bytes, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(BATCH_CONF, str(most))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir.  Only a local master, as in tests, may go without one and gets a folder of its own, removed at the end."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="shardloom-")
            _written.append((context, folder))
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove(context, path: str) -> None:
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def remove_written() -> None:
    """What ``shared_path`` named, if the session still runs."""
    for context, path in _written:
        if context._jsc is not None:
            try:
                remove(context, path)
            except Exception:  # noqa: BLE001  the session ended before
                break
    _written.clear()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the program."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext, path))
    return path

"""Cutting lineage: small intermediates are written once and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process and not yet deleted, with the session that wrote them.
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster
    an unset folder is an error, since executors could not share it.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """Path of a new folder in the shared folder, deleted with the process or its scope."""
    path = f"{shared_dir(spark)}/marketframe/{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return a scan of it.

    Used where a plan reads the same intermediate several times: the heavy
    upstream runs once, survives lost executors, and later joins see real file
    sizes.  The files are deleted at the end of the enclosing ``scope``, or when
    the driver process ends.
    """
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(paths: list[str]) -> None:
    for path in paths:
        spark = _WRITTEN.pop(path)
        jvm = spark.sparkContext._jvm
        if jvm is None:
            continue
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes what is materialised inside; results must be consumed before it ends."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        _delete([p for p in _WRITTEN if p not in before])


@atexit.register
def _at_exit() -> None:
    try:
        _delete(list(_WRITTEN))
    except Exception:  # the JVM may have ended first; its folder is then left to its owner
        _WRITTEN.clear()

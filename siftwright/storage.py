"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
#: folders made for local sessions that name none, by application; the setting itself cannot be set once a session runs
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, in one local process (tests), a temporary folder made once for the application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="siftwright-")
        root = _LOCAL[context.applicationId]
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses; what is written there is deleted when the process ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here, and a lost executor costs a re-read only."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a stored table."""
    where, system = file_system(spark, path)
    system.delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            forget(spark, path)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return

"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, fresh_path, shared_root

__all__ = ["drop", "forget", "free", "fresh_path", "identified", "shared_root", "stored"]


def free(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores more as set it apart from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def identified(df: DataFrame, row: str) -> DataFrame:
    """``df`` with a string of its own for each row that holds however often the table is read: its file and its place there.

    A table of Parquet files is taken as it is, any other is stored first.
    """
    name = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return df.withColumn(row, name)
        except AnalysisException:  # of a format that does not count its rows
            pass
    return stored(df, "rows").withColumn(row, name)


#: rows and bytes of one Arrow batch while a table is written: texts are long, and each batch stands in memory several times over
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH rows and bytes; a smaller bound that the session has stays."""
    had = {key: spark.conf.get(key) for key in BATCH}
    for key, most in BATCH.items():
        now = had[key].lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)
    try:
        yield
    finally:
        for key, was in had.items():
            spark.conf.set(key, was)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _small_batches(spark):
        df.write.parquet(path)
    # Spark drops shuffle files once the driver, both its Python and its JVM, has collected what refers to them
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            forget(df.sparkSession, path)

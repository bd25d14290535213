"""Text files read by many tasks, each row with its place in its file.

Spark cuts a large file at block offsets and reads each block in order, but
tells no row's number.  Here rows are counted by block in a first pass; a
running sum over a file's blocks (a few rows for each file) gives the number at
which a block begins, and a second pass adds a row's place inside its block.
No file, and no file's lines, are ever in one row or one task.

Both passes must cut files alike.  Where Spark cuts depends on settings and on
the cores that it finds when a scan starts, so files are read in a session of
their own that fixes all of them once: an executor lost or added in between, or
a setting that is changed, moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pytext import splitlines, strip


def fixed_session(spark: SparkSession, block: int | None, tasks: int | None = None) -> SparkSession:
    """A session with the settings of ``spark``, in which files are cut at blocks of at most ``block`` bytes (None: as now) and for ``tasks`` tasks (None: the cores of now), whatever happens to either."""
    own = spark.newSession()
    for key, value in dict(spark.conf.getAll).items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.minPartitionNum", str(tasks or spark.sparkContext.defaultParallelism))
    if block:
        own.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    return own


def rows_in_order(spark: SparkSession, paths: list[str] | str, separator: str | None = None, block: int | None = None) -> DataFrame:
    """(file, file_bytes, block, value): what stands between separators (without one: any line feed, carriage return or both), in order inside a block.

    Its rows come in the files' order within each task, so an expression above
    it may number them; passes that must agree have to start from one frame.
    """
    own = fixed_session(spark, block)
    reader = own.read if separator is None else own.read.option("lineSep", separator)
    meta = {"file": "file_path", "file_bytes": "file_size", "block": "file_block_start"}
    return reader.text(paths).select(*[F.col(f"_metadata.{of}").alias(name) for name, of in meta.items()], "value")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (with file and block, as rows_in_order gives them, perhaps filtered or exploded) with ``name``: their place in the file, from 0."""
    spark = rows.sparkSession
    # numbers of consecutive rows of a task are consecutive, so a block's rows are those from its least number on
    told = rows.withColumn("mid_", F.monotonically_increasing_id())
    blocks = told.groupBy("file", "block").agg(F.min("mid_").alias("least_"), F.count("*").alias("n_"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("file_"), F.col("block").alias("block_"), (F.coalesce(F.sum("n_").over(ahead), F.lit(0)) - F.col("least_")).alias("shift_"))
    met = told.join(blocks, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")), "left")
    place = F.coalesce(F.col("mid_") + F.col("shift_"), F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("file"))).cast("long"))
    return met.withColumn(name, place).drop("mid_", "file_", "block_", "shift_")


def pieces(value: Column) -> Column:
    """Lines of what stands between two separators, by all breaks of str.splitlines."""
    return splitlines(F.concat(value, F.lit("\n")))


def lines(spark: SparkSession, paths: list[str] | str, feeds_only: bool = False, block: int | None = None) -> DataFrame:
    """(file, block, pos, line): all lines that hold more than white space, stripped; pos counts every line from 0.

    Lines end as for str.splitlines or, with ``feeds_only``, at line feeds
    alone.  Of other breaks than line feed and carriage return a single row
    keeps what stands between two of those, so a file without any must fit in
    one.
    """
    rows = rows_in_order(spark, paths, "\n" if feeds_only else None, block)
    if not feeds_only:
        rows = rows.select("file", "block", F.explode(pieces(F.col("value"))).alias("value"))
    every = numbered(rows.select("file", "block", "value"), "pos")
    return every.select("file", "block", "pos", strip(F.col("value")).alias("line")).where("line <> ''")


def items(spark: SparkSession, paths: list[str] | str, block: int | None = None) -> DataFrame:
    """(file, item, line): nonblank lines, stripped; item counts them alone, from 1."""
    rows = rows_in_order(spark, paths, None, block).select("file", "block", F.explode(pieces(F.col("value"))).alias("value"))
    kept = rows.select("file", "block", strip(F.col("value")).alias("line")).where("line <> ''")
    return numbered(kept, "at").select("file", (F.col("at") + 1).alias("item"), "line")


def heads(spark: SparkSession, files: list[str], limit: int) -> DataFrame:
    """(file, pos, line): the first ``limit`` lines (by line feeds) of each file, blank ones too; pos counts from 0.

    A file is one partition here and its scan stops after ``limit`` rows, so
    what is read does not grow with the file.  Each file is a scan of its own.
    """
    own = fixed_session(spark, (1 << 63) - 1, tasks=1)
    out = None
    for file in files:
        rows = own.read.option("lineSep", "\n").text(file).limit(limit)
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        one = rows.select(F.lit(file).alias("file"), place.alias("pos"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out

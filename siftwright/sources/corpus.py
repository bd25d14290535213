"""Corpora, prompts and run history."""

from __future__ import annotations

import glob as globber
import os
import warnings
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pytext import splitlines, strip
from . import splits

PROMPT_FIELDS = ("name", "type", "system_prompt", "prompt_template", "description", "category", "output_format")
PROMPT_SCHEMA = ", ".join(f"{f} string" for f in PROMPT_FIELDS)


def items(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per nonblank line: all columns but ``text``, item (1-based among kept lines), tag (four digits or more), line."""
    keep = [c for c in texts.columns if c != text]
    lines = F.filter(F.transform(splitlines(F.col(text)), strip), lambda x: x != "")
    out = texts.select(*keep, F.posexplode(lines).alias("pos", "line"))
    return tagged(out.withColumn("item", F.col("pos") + 1)).select(*keep, "item", "tag", "line")


def tagged(lines: DataFrame, item: str = "item") -> DataFrame:
    """``lines`` with tag: the item's number in four digits or more."""
    n = F.col(item)
    return lines.withColumn("tag", F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))


def read_corpus(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    """Items of UTF-8 files of any size (input_source, item, tag, line); an empty corpus raises."""
    out = splits.items(spark, path, block)
    if out.isEmpty():
        raise ValueError(f"no items in {path}")
    return tagged(out).select(F.concat(F.lit("file:"), F.col("file")).alias("input_source"), "item", "tag", "line")


def read_whole(spark: SparkSession, file: str | None = None, text: str | None = None, stdin: str | None = None) -> DataFrame:
    """One item: a whole file, else a given text, else standard input; blank raises."""
    if file is not None:
        out = spark.read.text(file, wholetext=True).select(F.lit(f"file:{file}").alias("input_source"), F.col("value").alias("text"))
    else:
        got, name = (text, "cli") if text is not None else (stdin, "stdin")
        out = spark.createDataFrame([(name, got or "")], "input_source string, text string")
    out = whole(out)
    if out.isEmpty():
        raise ValueError("the text is empty")
    return out


def whole(texts: DataFrame, text: str = "text") -> DataFrame:
    """Texts stripped, blank ones dropped, with text_length in code points."""
    return texts.withColumn(text, strip(F.col(text))).where(F.col(text) != "").withColumn("text_length", F.length(text))


def expand_inputs(patterns: list[str]) -> list[str]:
    """Local paths and globs in order, each once; one without a match warns."""
    out: dict[str, None] = {}
    for p in patterns:
        found = sorted(globber.glob(p)) if any(c in p for c in "*?[") else [p] * os.path.exists(p)
        if not found:
            warnings.warn(f"no input matches {p}", stacklevel=2)
        out |= dict.fromkeys(found)
    return list(out)


def prompts_of(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """Prompt records of JSON lines, by name; of records with one name the last.  A malformed line fails the query."""
    got = lines.where(strip(F.col(line)) != "").select(order, F.from_json(line, PROMPT_SCHEMA, {"mode": "FAILFAST"}).alias("p"))
    last = got.groupBy(F.col("p.name").alias("key")).agg(F.max_by("p", order).alias("p"))
    return last.select("p.*")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt records of a JSONL file."""
    text = spark.read.text(path, wholetext=True)
    return prompts_of(text.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")))


def missing_dimensions(prompts: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Required dimensions (dim) without a prompt."""
    need = prompts.sparkSession.createDataFrame([(d,) for d in required], "dim string")
    return need.join(prompts.select(F.col("name").alias("dim")), "dim", "left_anti")


def check_prompts(prompts: DataFrame, required: tuple[str, ...]) -> DataFrame:
    gone = [r.dim for r in missing_dimensions(prompts, required).collect()]  # dimensions are few
    if gone:
        raise ValueError(f"no prompt for {', '.join(sorted(gone))}")
    return prompts


def append_history(df: DataFrame, path: str) -> None:
    """Run records (id, ts, page, command, log, outputs) are appended; none overwrites another."""
    df.write.mode("append").json(path)


def latest_runs(history: DataFrame, n: int = 20, log_chars: int = 1500) -> DataFrame:
    """The n newest records by id, logs cut short."""
    rank = Window.orderBy(F.desc("id"))
    top = history.orderBy(F.desc("id")).limit(n)
    return top.withColumn("place", F.row_number().over(rank)).withColumn("log", F.substring("log", 1, log_chars))


def clear_history(spark: SparkSession, path: str) -> None:
    """Deletes all run records."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stamped(prefix: str, suffix: str = ".json", now: datetime | None = None) -> str:
    """A name with the local time to the second, such as eval_report_20240131_235959.json."""
    return f"{prefix}_{(now or datetime.now()):%Y%m%d_%H%M%S}{suffix}"

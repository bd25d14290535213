"""End to end: corpus -> judged rounds -> scores -> reports, training records and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import EvalConfig
from ..operators import evaluate, parse, reports, stats
from ..operators.judging import KEYS, Judge
from ..sources.corpus import check_prompts, read_prompts
from ..sources.reports import write_merged, write_records
from ..storage import forget, fresh_path

STORED = [*KEYS, "dim_ord", "model_ord", "model_label", "raw", "score", "reason", "error"]
ANSWERS = "doc_id {}, dim string, model string, dim_ord int, model_ord int, model_label string, raw string, score double, reason string, error string"
#: calls in a partition, at most on average: a lost executor repeats no more than that a core
TASKS = 96
#: partitions of a batch, and batches of a round, at most
MOST = 10_000


def _read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame | None:
    """The answers under a path; None if there are none."""
    try:
        return spark.read.schema(ANSWERS.format(id_type)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def _batches(calls: int, cores: int) -> int:
    """Batches of a round: each keeps all cores busy four times over, until there would be too many."""
    return min(MOST, max(1, -(-calls // (TASKS * 4 * cores))))


def judge_round(docs: DataFrame, judge: Judge, cfg: EvalConfig, prompts: DataFrame, rnd: int, previous: DataFrame | None, path: str) -> DataFrame:
    """Judgments of one round, kept as Parquet under ``path``; a call whose answer is there already is not made again.

    Answers are written before anything reads them, so no later action calls a
    judge a second time.  Documents that lack an answer are dealt into batches,
    stored by batch, and asked a batch at a time: each is a job of a bounded
    number of partitions, and every task's answers are committed when the task
    ends.  A run that is killed, or one of whose tasks fails, keeps them; the
    next run asks for the rest only.  Batches and partitions are bounded
    whatever the number of documents; prompts are made where the judge is asked.
    """
    spark = docs.sparkSession
    where, each = f"{path}/round={rnd}", len(cfg.dimensions) * len(cfg.models)
    keep = ("n_chars",) * ("n_chars" in docs.columns)
    none = F.array().cast("array<struct<dim:string,model:string>>")
    left, id_type = docs.select("doc_id", "text", *keep), docs.schema["doc_id"].dataType.simpleString()
    had = _read(spark, where, id_type)
    if had is None:
        left = left.withColumn("done", none)
    else:
        done = had.groupBy("doc_id").agg(F.collect_set(F.struct("dim", "model")).alias("done"))
        left = left.join(done, "doc_id", "left").withColumn("done", F.coalesce("done", none)).where(F.size("done") < each)
    if previous is not None:
        left = evaluate.with_feedback(left, previous)
    n = _batches(left.select("doc_id").count() * each, spark.sparkContext.defaultParallelism)
    todo = fresh_path(spark, "to-judge")
    left.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartition("batch").write.partitionBy("batch").parquet(todo)
    waiting = spark.read.schema(StructType([*left.schema.fields, StructField("batch", IntegerType())])).parquet(todo)
    sizes = {r.batch: r.n for r in waiting.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # at most MOST
    for batch in sorted(sizes):
        rows = waiting.where(F.col("batch") == batch).drop("batch").repartition(min(MOST, -(-sizes[batch] * each // TASKS)))
        tasks = evaluate.prompt_rows(rows, prompts, cfg, (*keep, "done"))
        tasks = tasks.crossJoin(F.broadcast(evaluate.models(spark, cfg))).withColumn("round", F.lit(rnd))
        tasks = tasks.where(~F.array_contains("done", F.struct("dim", "model"))).drop("done")
        answers = evaluate.judge_rows(judge.answer(tasks)).select(*STORED).drop("round")
        # version 2 of the committer publishes what a task wrote when the task ends, not when the job does
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", 2).parquet(where)
    forget(spark, todo)
    got = _read(spark, where, id_type)
    if got is None:
        got = spark.createDataFrame([], ANSWERS.format(id_type))
    return got.withColumn("round", F.lit(rnd)).select(*STORED)


def progress(spark: SparkSession, path: str, documents: int, cfg: EvalConfig) -> DataFrame:
    """round, answered, calls and percent of the judged rounds under ``path``, also while a run goes on; counts never fall."""
    calls = documents * len(cfg.dimensions) * len(cfg.models)
    rows = []
    for rnd in range(1, cfg.rounds + 1):
        got = _read(spark, f"{path}/round={rnd}")
        rows.append((rnd, got.count() if got is not None else 0))
    share = F.when(F.lit(calls) > 0, F.bround(F.col("answered") * 100.0 / calls, 1)).otherwise(100.0)
    return spark.createDataFrame(rows, "round int, answered long").select("round", "answered", F.lit(calls).cast("long").alias("calls"), share.alias("percent"))


def run_rounds(docs: DataFrame, judge: Judge, cfg: EvalConfig, path: str) -> DataFrame:
    """All rounds' judgments of docs (doc_id, text)."""
    prompts = check_prompts(read_prompts(docs.sparkSession, cfg.prompts), cfg.dimensions)
    out = previous = None
    for rnd in range(1, cfg.rounds + 1):
        previous = judge_round(docs, judge, cfg, prompts, rnd, previous, path)
        out = previous if out is None else out.unionByName(previous)
    return out


@dataclass
class Run:
    judgments: DataFrame
    finals: DataFrame
    reports: DataFrame
    records: DataFrame
    summary: DataFrame


def run(docs: DataFrame, judge: Judge, cfg: EvalConfig, path: str, kind: str = "alpaca", threshold: float | None = None) -> Run:
    """The whole run.  Stored verdicts use cfg.threshold; filtering and statistics use ``threshold`` if it is given.

    A document whose calls all fail has a report without a score and drops out
    of the training records alone; a run without any report fails.
    """
    limit = cfg.threshold if threshold is None else threshold
    judged = run_rounds(docs, judge, cfg, f"{path}/judgments")
    finals = evaluate.final_scores(evaluate.dim_scores(judged.where(F.col("round") == cfg.rounds)), cfg)
    nested = reports.as_json(reports.nested(docs, judged, finals, evaluate.round_trend(judged, cfg), cfg, stamp=True))
    write_merged(nested, f"{path}/reports", "doc_id")
    if finals.isEmpty():
        raise ValueError("no report at all: nothing to convert or to count")
    classified = reports.classify(nested, limit)
    kept = parse.parse(classified.where("convert_class = 'kept'").select("doc_id", "text"))
    records = (parse.to_alpaca if kind == "alpaca" else parse.to_sharegpt)(kept)
    write_records(records.drop("type"), f"{path}/{kind}", "doc_id")
    return Run(judged, finals, nested, records, stats.run_summary(docs, classified))

"""Scores of documents that keep arriving: stateless, so the batch expressions serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import EvalConfig
from ..operators import evaluate
from ..operators.judging import Judge


def scored(batch: DataFrame, judge: Judge, cfg: EvalConfig) -> DataFrame:
    """Final scores of one round of documents (doc_id and what the judge needs)."""
    rows = evaluate.judge_rows(judge.answer(evaluate.task_grid(batch, cfg, [1])))
    return evaluate.final_scores(evaluate.dim_scores(rows), cfg)


def score_stream(docs: DataFrame, judge: Judge, cfg: EvalConfig, path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch is scored and written to ``path``/epoch=N, replaced if the batch is run again, so results are exactly once."""

    def write(batch: DataFrame, epoch: int) -> None:
        scored(batch, judge, cfg).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def pass_rates(finals: DataFrame, at: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of passed and scored documents in event-time windows of a stream of finals with a time column."""
    return finals.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))

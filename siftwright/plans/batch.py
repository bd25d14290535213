"""Command: a file of texts, one a line, becomes judged reports, training records and printed statistics.

``python -m siftwright.plans.batch --input FILE --format alpaca --output FOLDER``
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..operators import reports, stats
from ..operators.judging import HttpJudge, Judge, SyntheticJudge
from ..operators.render import statistics_text
from ..sources.corpus import read_corpus
from . import evaluation


def corpus_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (place among the lines that hold text), text and n_chars; a corpus without any raises."""
    items = read_corpus(spark, path)
    return items.select(F.col("item").cast("long").alias("doc_id"), F.col("line").alias("text"), F.length("line").cast("long").alias("n_chars"))


def run_batch(spark: SparkSession, path: str, judge: Judge, cfg: EvalConfig, out: str, kind: str = "alpaca", threshold: float | None = None) -> tuple[evaluation.Run, str]:
    """evaluation.run over a corpus file, and its statistics as text."""
    done = evaluation.run(corpus_documents(spark, path), judge, cfg, out, kind, threshold)
    limit = cfg.threshold if threshold is None else threshold
    rows = done.reports.select(F.col("doc_id").alias("ord"), "report")
    text = statistics_text(stats.summary(reports.classify(rows, limit)), stats.dim_table(reports.dimension_rows(rows), cfg), stats.model_table(reports.flatten(rows)), limit)
    s = done.summary.first()
    last = f"\n共处理 {s.total}  合格 {s.passed}  不合格 {s.failed}  无效 {s.invalid}\n输出: {out}/{kind}"
    return done, text + last


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--format", choices=("alpaca", "sharegpt"), required=True)
    p.add_argument("--threshold", type=float, default=5.0)
    p.add_argument("--rounds", type=int, default=1)
    p.add_argument("--env", default=".env", help="file with keys")
    p.add_argument("--endpoint", action="append", default=[], metavar="MODEL=URL,NAME,VARIABLE", help="a judge's endpoint; without any, the synthetic judge answers")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    cfg = EvalConfig(rounds=a.rounds)
    judge: Judge = SyntheticJudge()
    if a.endpoint:
        ends = {model: tuple(rest.split(",")) for model, _, rest in (e.partition("=") for e in a.endpoint)}
        judge = HttpJudge(ends, env_file=os.path.abspath(a.env))
        judge.missing_keys()
    print(run_batch(spark, a.input, judge, cfg, a.output, a.format, a.threshold)[1])


if __name__ == "__main__":
    main()

"""Commands on report files and single texts.

``python -m siftwright.plans.files convert --input FILE --output FOLDER --format alpaca``
``python -m siftwright.plans.files statistics FILE...``
``python -m siftwright.plans.files evaluate --text TEXT --output FOLDER``
``python -m siftwright.plans.files curate --input FOLDER --output FOLDER``
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..operators import curation, parse, render, reports, stats
from ..operators.judging import Judge, SyntheticJudge
from ..sources import corpus
from ..sources import reports as files
from . import evaluation


def in_order(spark: SparkSession, paths: list[str], mode: str) -> DataFrame:
    """ord, report of several inputs (files, globs), one after the other; ord counts by input, file and place."""
    parts = [files.read_reports(spark, p, mode).withColumn("input", F.lit(i)) for i, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, parts)
    # a file's place among the files is a small number; reports are not sorted
    names = rows.select("input", "file").distinct()
    nth = F.row_number().over(Window.orderBy("input", "file"))
    return rows.join(names.withColumn("nth", nth), ["input", "file"]).select(F.struct("nth", "ord").alias("ord"), "report")


def convert(spark: SparkSession, path: str, out: str, kind: str = "alpaca", threshold: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Training records of the reports in ``path`` at or above the threshold, written under ``out``; the records and their statistics."""
    rows = in_order(spark, [path], "strict")
    seen = reports.classify(rows, threshold)
    parsed = parse.parse(seen.where("convert_class = 'kept'").select("ord", "text"))
    records = (parse.to_alpaca if kind == "alpaca" else parse.to_sharegpt)(parsed).drop("type")
    files.write_records(records, out, "ord")
    return records, stats.convert_stats(seen, parsed)


def statistics(spark: SparkSession, paths: list[str], cfg: EvalConfig, threshold: float | None = None) -> str:
    """Statistics of all reports of the inputs, as text."""
    limit = cfg.threshold if threshold is None else threshold
    rows = in_order(spark, paths, "objects")
    return render.statistics_text(stats.summary(reports.classify(rows, limit)), stats.dim_table(reports.dimension_rows(rows), cfg), stats.model_table(reports.flatten(rows)), limit)


def evaluate_one(spark: SparkSession, judge: Judge, cfg: EvalConfig, out: str, **source: str | None) -> tuple[evaluation.Run, str]:
    """One text (``file``, ``text`` or ``stdin``, as corpus.read_whole takes it) judged in all rounds; its report is written under ``out``."""
    docs = corpus.read_whole(spark, **source).select(F.lit(1).cast("long").alias("doc_id"), "text", F.col("text_length").cast("long").alias("n_chars"))
    done = evaluation.run(docs, judge, cfg, out)
    return done, render.evaluation_text(done.judgments, cfg) + f"\n\n报告: {out}/reports"


def curate(spark: SparkSession, rows: DataFrame, out: str | None, keep_invalid: bool = False, sections: tuple[str, ...] = (), id: str = "doc_id", text: str = "text") -> tuple[curation.Curated, str]:
    """The curated set, its ledger and its data card; written under ``out`` as curated, ledger and card, or only told (None)."""
    got = curation.curate(rows, keep_invalid=keep_invalid, id=id, text=text)
    told = curation.card_text(curation.card(got, list(sections), text), got.ledger, "data card")
    if out is not None:
        got.kept.write.mode("overwrite").json(f"{out}/curated")
        got.ledger.write.mode("overwrite").json(f"{out}/ledger")
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/card")
    return got, told


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("convert")
    one.add_argument("--input", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--format", choices=("alpaca", "sharegpt"), required=True)
    one.add_argument("--threshold", type=float, default=5.0)
    one = sub.add_parser("statistics")
    one.add_argument("inputs", nargs="+")
    one.add_argument("--threshold", type=float, default=5.0)
    one = sub.add_parser("evaluate")
    one.add_argument("--file")
    one.add_argument("--text")
    one.add_argument("--output", required=True)
    one.add_argument("--rounds", type=int, default=3)
    one = sub.add_parser("curate")
    one.add_argument("--input", required=True, help="JSON lines with doc_id and text")
    one.add_argument("--output", help="without it, nothing is written")
    one.add_argument("--keep-invalid", action="store_true")
    one.add_argument("--section", action="append", default=[])
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "convert":
        print(render.conversion_text(convert(spark, a.input, a.output, a.format, a.threshold)[1], a.format, a.output, a.threshold))
    elif a.command == "statistics":
        print(statistics(spark, corpus.expand_inputs(a.inputs), EvalConfig(), a.threshold))
    elif a.command == "evaluate":
        print(evaluate_one(spark, SyntheticJudge(), EvalConfig(rounds=a.rounds), a.output, file=a.file, text=a.text)[1])
    else:
        print(curate(spark, spark.read.json(a.input), a.output, a.keep_invalid, tuple(a.section))[1])


if __name__ == "__main__":
    main()

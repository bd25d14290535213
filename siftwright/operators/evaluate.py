"""Task grid, prompts, judgments, scores, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import EvalConfig
from ..functions.pytext import round2, strip
from ..functions.score import extract_reason, extract_score


def dimensions(spark: SparkSession, cfg: EvalConfig) -> DataFrame:
    return spark.createDataFrame([(i, d) for i, d in enumerate(cfg.dimensions)], "dim_ord int, dim string")


def models(spark: SparkSession, cfg: EvalConfig) -> DataFrame:
    return spark.createDataFrame([(i, k, label) for i, (k, label) in enumerate(cfg.models)], "model_ord int, model string, model_label string")


def task_grid(docs: DataFrame, cfg: EvalConfig, rounds: list[int] | None = None) -> DataFrame:
    """Documents x rounds x dimensions x models; the three right sides are configuration and are broadcast."""
    spark = docs.sparkSession
    turns = spark.createDataFrame([(r,) for r in rounds or range(1, cfg.rounds + 1)], "round int")
    out = docs
    for side in (turns, dimensions(spark, cfg), models(spark, cfg)):
        out = out.crossJoin(F.broadcast(side))
    return out


def render(template: Column, text: Column) -> Column:
    """{text} is replaced literally, wherever it stands."""
    return F.replace(template, F.lit("{text}"), text)


def feedback(judgments: DataFrame) -> DataFrame:
    """doc_id, dim, round (the next one) and feedback: all models' last scores and reasons, in the models' order."""
    reason = F.substring(F.replace(strip(F.coalesce("reason", F.lit(""))), F.lit("\n"), F.lit(" ")), 1, C.REFINE_REASON)
    score = F.coalesce(F.col("score").cast("string"), F.lit(C.REFINE_NONE))
    a, b, c = (F.lit(x) for x in C.REFINE_LINE)
    line = F.concat(a, "model_label", b, score, c, reason)
    lines = F.array_sort(F.collect_list(F.struct("model_ord", line.alias("line"))))
    return judgments.groupBy("doc_id", "dim", (F.col("round") + 1).alias("round")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("feedback"))


def with_feedback(docs: DataFrame, previous: DataFrame) -> DataFrame:
    """docs with ``told``: the feedback of the ``previous`` round's judgments by dimension.  One join by doc_id, whatever the number of dimensions."""
    told = feedback(previous).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "feedback"))).alias("told"))
    return docs.join(told, "doc_id", "left")


def prompt_rows(docs: DataFrame, prompts: DataFrame, cfg: EvalConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, dim_ord, dim, system_prompt and prompt for each document (doc_id, text) and dimension.

    With a column ``told`` (with_feedback) it is the prompt of a later round.
    Texts are copied here and not before, so no copy is shuffled.
    """
    dims = dimensions(docs.sparkSession, cfg).join(prompts.select(F.col("name").alias("dim"), "system_prompt", "prompt_template"), "dim")
    prompt = render(F.col("prompt_template"), F.col("text"))
    if "told" in docs.columns:
        prompt = F.concat(prompt, F.lit(f"\n\n{C.REFINE_HEAD}\n"), F.coalesce(F.try_element_at("told", F.col("dim")), F.lit("")), F.lit(f"\n\n{C.REFINE_TAIL}"))
    return docs.crossJoin(F.broadcast(dims)).select("doc_id", *keep, "dim_ord", "dim", "system_prompt", prompt.alias("prompt"))


def judge_rows(answers: DataFrame) -> DataFrame:
    """Scores and reasons of answers: a failed call has no reason; an answer without a score keeps itself as reason and an error."""
    score = F.when(F.col("error").isNull(), extract_score(F.col("raw")))
    error = F.coalesce(F.col("error"), F.when(score.isNull(), C.UNPARSED))
    return answers.withColumn("score", score).withColumn("reason", F.when(F.col("error").isNull(), F.col("raw")).otherwise("")).withColumn("error", error)


def summaries(judgments: DataFrame) -> DataFrame:
    """Short reasons for display."""
    return judgments.withColumn("summary", F.when(F.col("raw").isNotNull(), extract_reason(F.col("raw"))))


def dim_scores(judgments: DataFrame, by: tuple[str, ...] = ("doc_id", "dim_ord", "dim")) -> DataFrame:
    """Mean over models, rounded; null where no model gave a score.  Sums of quarter points are exact in any order."""
    return judgments.groupBy(*by).agg(round2(F.sum("score") / F.count("score")).alias("score"), F.count("score").alias("n_scores"))


def final_scores(scores: DataFrame, cfg: EvalConfig, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One column per dimension, overall_score, passed and conclusion.

    overall is the weighted mean of the dimensions that have a score, added in
    their order; null (and failed) if none has.
    """
    wide = scores.groupBy(*by).pivot("dim", list(cfg.dimensions)).agg(F.first("score"))
    used = [(d, float(cfg.weights.get(d, 0.0))) for d in cfg.dimensions if cfg.weights.get(d, 0.0) > 0]
    zero = F.lit(0.0)
    total = reduce(lambda a, x: a + F.coalesce(F.col(x[0]) * F.lit(x[1]), zero), used, zero)
    weight = reduce(lambda a, x: a + F.when(F.col(x[0]).isNull(), zero).otherwise(F.lit(x[1])), used, zero)
    overall = F.when(weight > 0, round2(total / weight))
    return conclude(wide.withColumn("overall_score", overall), cfg.threshold)


def conclude(df: DataFrame, threshold: float) -> DataFrame:
    passed = F.coalesce(F.col("overall_score") >= threshold, F.lit(False))
    return df.withColumn("passed", passed).withColumn("conclusion", F.when(passed, C.PASSED).otherwise(C.FAILED))


def contributions(scores: DataFrame, cfg: EvalConfig) -> DataFrame:
    """score x weight of each dimension, rounded, and the weight in percent."""
    weights = F.create_map(*[F.lit(x) for d in cfg.dimensions for x in (d, float(cfg.weights.get(d, 0.0)))])
    w = F.element_at(weights, F.col("dim"))
    return scores.withColumn("label", label(F.col("dim"), cfg)).withColumn("percent", F.bround(w * 100, 0).cast("int")).withColumn("part", round2(F.col("score") * w))


def label(dim: Column, cfg: EvalConfig) -> Column:
    """A dimension's label, itself if it has none."""
    names = F.create_map(*[F.lit(x) for kv in cfg.labels.items() for x in kv])
    return F.coalesce(F.try_element_at(names, dim), dim)


def round_trend(judgments: DataFrame, cfg: EvalConfig) -> DataFrame:
    """doc_id, dim_ord, dim and trend: the rounded mean of each round, null kept in its place."""
    means = dim_scores(judgments, ("doc_id", "dim_ord", "dim", "round"))
    got = F.map_from_entries(F.collect_list(F.struct("round", "score")))
    out = means.groupBy("doc_id", "dim_ord", "dim").agg(got.alias("got"))
    turns = F.array(*[F.lit(r) for r in range(1, cfg.rounds + 1)])
    return out.select("doc_id", "dim_ord", "dim", F.transform(turns, lambda r: F.try_element_at(F.col("got"), r)).alias("trend"))


def arrow(trend: Column) -> Column:
    """First against last score of a trend; fewer than two are level."""
    known = F.filter(trend, lambda x: x.isNotNull())
    first, last = F.get(known, F.lit(0)), F.try_element_at(known, F.lit(-1))
    return F.when((F.size(known) < 2) | (first == last), "→").when(last > first, "↑").otherwise("↓")


def arrow_by_window(means: DataFrame) -> DataFrame:
    """The same from rows (doc_id, dim, round, score), for trends too long for an array."""
    w = Window.partitionBy("doc_id", "dim").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("score", True).over(w), F.last("score", True).over(w)
    few = F.count("score").over(w) < 2
    return means.withColumn("arrow", F.when(few | (first == last), "→").when(last > first, "↑").otherwise("↓"))

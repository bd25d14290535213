"""Nested reports: built from judgments, flattened back, classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..functions.typed import is_number_loose, is_number_strict, is_string, number
from ..sources.reports import NO_LIMITS, OBJECT


def nested(docs: DataFrame, judgments: DataFrame, finals: DataFrame, trends: DataFrame, cfg: EvalConfig, source: str = "cli", stamp: bool = False) -> DataFrame:
    """doc_id and report (meta, rounds, final) for each document (doc_id, text)."""
    one = F.struct(F.col("score"), F.col("reason"), F.col("error"))
    first = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    in_order = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("o", "k", "v")), first), lambda x: F.struct(x["k"], x["v"])))
    rows = judgments.select("doc_id", "round", "dim_ord", "dim", F.col("model_ord").alias("o"), F.col("model_label").alias("k"), one.alias("v"))
    dims = rows.groupBy("doc_id", "round", "dim_ord", "dim").agg(in_order.alias("v"))
    dims = dims.select("doc_id", "round", F.col("dim_ord").alias("o"), F.col("dim").alias("k"), "v")
    rounds = dims.groupBy("doc_id", "round").agg(in_order.alias("dimensions"))
    rounds = _ordered_rounds(rounds)
    trend = trends.groupBy("doc_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("dim_ord", "dim", "trend"))), lambda x: F.struct(x["dim"], x["trend"]))).alias("round_trend"))
    scores = F.create_map(*[x for d in cfg.dimensions for x in (F.lit(d), F.col(f"`{d}`"))])
    weights = F.create_map(*[F.lit(x) for d in cfg.dimensions for x in (d, float(cfg.weights.get(d, 0.0)))])
    meta = [F.lit(source).alias("input_source"), F.col("text"), F.length("text").alias("text_length"), F.array(*[F.lit(m) for _, m in cfg.models]).alias("models"), F.lit(cfg.rounds).alias("rounds"), F.lit(cfg.threshold).alias("threshold")]
    if stamp:
        meta.append(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"))
    final = F.struct(scores.alias("dimension_scores"), weights.alias("weights"), "overall_score", "passed", "conclusion", "round_trend")
    out = docs.select("doc_id", "text").join(rounds, "doc_id").join(finals, "doc_id").join(trend, "doc_id")
    return out.select("doc_id", F.struct(F.struct(*meta).alias("meta"), "rounds", final.alias("final")).alias("report"))


def _ordered_rounds(rounds: DataFrame) -> DataFrame:
    """Maps cannot be compared, so rounds are ordered by their number alone."""
    got = F.map_from_entries(F.collect_list(F.struct("round", "dimensions")))
    out = rounds.groupBy("doc_id").agg(got.alias("m"), F.sort_array(F.collect_list("round")).alias("order"))
    return out.select("doc_id", F.transform("order", lambda r: F.struct(r.alias("round"), F.element_at("m", r).alias("dimensions"))).alias("rounds"))


def as_json(reports: DataFrame) -> DataFrame:
    """The report as a JSON string, null scores kept; a judgment without an error has no such key.

    Inside a JSON string every quote has a backslash before it, so the pattern meets keys only.
    """
    text = F.to_json("report", {"ignoreNullFields": "false"})
    return reports.withColumn("report", F.replace(text, F.lit(',"error":null}'), F.lit("}")))


def _open(j: Column) -> dict[str, Column]:
    top = F.from_json(j, OBJECT, NO_LIMITS)
    final, meta = top["final"], top["meta"]
    get = lambda v, path: F.try_variant_get(v, path, "variant")
    return {"top": top, "overall": get(final, "$.overall_score"), "text": get(meta, "$.text"), "passed": F.try_variant_get(final, "$.passed", "boolean")}


def classify(reports: DataFrame, threshold: float, report: str = "report") -> DataFrame:
    """Adds overall, text, stored_passed and three classes.

    convert_class: skipped (no object, no score or text, score no number even
    counting booleans, text no string), low or kept; NaN is kept.
    view_class: dropped (no object), invalid (score no strict number), passed
    or failed; NaN fails.  web_passed: the stored verdict or the threshold; a
    missing score is 0, one that is no number does not pass.
    """
    o = _open(F.col(report))
    out = reports.withColumn("__o", F.struct(o["overall"].alias("overall"), o["text"].alias("text"), o["passed"].alias("passed"), o["top"].isNotNull().alias("object")))
    v, x = F.col("__o.overall"), number(F.col("__o.overall"))
    kept = F.when(~F.col("__o.object") | v.isNull() | ~is_number_loose(v) | ~is_string(F.col("__o.text")), "skipped").when((x < threshold) & ~F.isnan(x), "low").otherwise("kept")
    view = F.when(~F.col("__o.object"), "dropped").when(~is_number_strict(v), "invalid").when((x >= threshold) & ~F.isnan(x), "passed").otherwise("failed")
    score = F.when(v.isNull(), 0.0).when(is_number_loose(v), x)
    web = F.coalesce(F.col("__o.passed"), F.lit(False)) | F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False))
    return out.select(*reports.columns, F.when(is_number_loose(v), x).alias("overall"), F.try_variant_get("__o.text", "$", "string").alias("text"), F.col("__o.passed").alias("stored_passed"), kept.alias("convert_class"), view.alias("view_class"), (F.col("__o.object") & web).alias("web_passed")).drop("__o")


def flatten(reports: DataFrame, report: str = "report") -> DataFrame:
    """Judgments of report strings: all other columns, round_pos, round, dim_pos, dim, model_pos, model, score; strict numbers only."""
    keep = [c for c in reports.columns if c != report]
    shape = "struct<rounds:array<struct<round:int,dimensions:map<string,map<string,variant>>>>>"
    rows = reports.select(*keep, F.from_json(report, shape, NO_LIMITS)["rounds"].alias("r"))
    rows = rows.select(*keep, F.posexplode("r").alias("round_pos", "r"))
    rows = rows.select(*keep, "round_pos", F.col("r.round").alias("round"), F.posexplode("r.dimensions").alias("dim_pos", "dim", "m"))
    rows = rows.select(*keep, "round_pos", "round", "dim_pos", "dim", F.posexplode("m").alias("model_pos", "model", "v"))
    score = F.try_variant_get("v", "$.score", "variant")
    return rows.where(is_number_strict(score)).withColumn("score", number(score)).drop("v")


def dimension_rows(reports: DataFrame, report: str = "report") -> DataFrame:
    """Stored dimension scores: all other columns, pos, dim, loose (booleans as numbers) and score (strict numbers)."""
    keep = [c for c in reports.columns if c != report]
    final = F.from_json(report, "struct<final:struct<dimension_scores:map<string,variant>>>", NO_LIMITS)["final"]
    rows = reports.select(*keep, F.posexplode(final["dimension_scores"]).alias("pos", "dim", "v"))
    return rows.select(*keep, "pos", "dim", F.when(is_number_strict(F.col("v")), number(F.col("v"))).alias("score"), F.when(is_number_loose(F.col("v")), number(F.col("v"))).alias("loose"))

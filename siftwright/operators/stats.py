"""Statistics of classified and flattened reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..functions import exact
from ..functions.pytext import round2
from ..functions.score import bar, bucket
from .evaluate import label


def summary(classified: DataFrame) -> DataFrame:
    """total, passed, failed, invalid and their percentages of the total (objects only)."""
    rows = classified.where("view_class <> 'dropped'")
    n = F.count("*")
    parts = {c: F.count_if(F.col("view_class") == c) for c in ("passed", "failed", "invalid")}
    percent = [F.when(n > 0, F.lit(100.0) * v / n).otherwise(0.0).alias(f"{c}_percent") for c, v in parts.items()]
    return rows.agg(n.alias("total"), *[v.alias(c) for c, v in parts.items()], *percent)


def _standard(cfg: EvalConfig):
    places = F.create_map(*[F.lit(x) for i, d in enumerate(cfg.dimensions) for x in (d, i)])
    return F.try_element_at(places, F.col("dim"))


def dim_table(dims: DataFrame, cfg: EvalConfig, order: str = "ord") -> DataFrame:
    """Of dimension_rows: place, dim, label, average (unrounded, null without scores), n, low, middle, high.

    Configured dimensions come first, others in the order in which they first
    occur; ``order`` tells the reports' order.
    """
    scored = dims.where("score is not null").withColumn("b", bucket(F.col("score")))
    seen = F.min(F.struct(F.col(order).alias("o"), "pos"))
    got = scored.groupBy("dim").agg(F.avg("score").alias("average"), F.count("*").alias("n"), *[F.count_if(F.col("b") == i).alias(c) for i, c in enumerate(("low", "middle", "high"))], seen.alias("seen"))
    base = dims.sparkSession.createDataFrame([(d,) for d in cfg.dimensions], "dim string")
    out = got.join(base, "dim", "full").withColumn("std", _standard(cfg))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "low", "middle", "high")]
    place = F.row_number().over(Window.orderBy(F.coalesce("std", F.lit(2**31 - 1)), "seen.o", "seen.pos", "dim"))
    return out.select(place.alias("place"), "dim", label(F.col("dim"), cfg).alias("label"), "average", *zero)


def bars(table: DataFrame, width: int = 10) -> DataFrame:
    """dim_table with a bar of each average."""
    return table.withColumn("bar", bar(F.col("average"), width))


def model_table(rows: DataFrame, group: tuple[str, ...] = ("ord", "round_pos", "dim")) -> DataFrame:
    """Of flattened judgments: model, n, mean, std (of the sample, 0 for one), mean_diff.

    mean_diff averages a score's distance from the mean of the other models of
    its report, round and dimension (added in the report's order); null if it
    never had company.  Sums are exact and rounded once, so the result depends
    neither on the rows' order nor on partitions; a model is one row there.
    """
    place = "model_pos" if "model_pos" in rows.columns else "model"
    # a group is a report's judgments of one dimension: a few rows
    met = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), "model", "score"))).alias("g"))
    met = met.select("g", F.posexplode("g").alias("i", "x"))
    others = F.aggregate(F.filter("g", lambda y, j: j != F.col("i")), F.lit(0.0), lambda total, y: total + y["score"])
    apart = F.when(F.size("g") > 1, F.abs(F.col("x.score") - others / (F.size("g") - 1)))
    cut = met.select("x.model", exact.limbs(F.col("x.score")).alias("s"), apart.alias("apart")).withColumn("a", F.when(F.col("apart").isNotNull(), exact.limbs(F.col("apart"))))
    told = cut.groupBy("model").agg(*exact.sums("s"), *exact.sums("a"))
    return told.select("model", F.col("s_n").alias("n"), exact.mean("s_n", "s_s").alias("mean"), exact.deviation("s_n", "s_s", "s_p").alias("std"), F.when(F.col("a_n") > 0, exact.mean("a_n", "a_s")).alias("mean_diff"))


def web_summary(classified: DataFrame, dims: DataFrame, cfg: EvalConfig) -> DataFrame:
    """total, passed, pass_rate and the rounded average of each dimension (booleans as numbers; 0 without scores)."""
    rows = classified.where("view_class <> 'dropped'")
    head = rows.agg(F.count("*").alias("total"), F.count_if("web_passed").alias("passed"))
    head = head.withColumn("pass_rate", F.when(F.col("total") > 0, F.col("passed") / F.col("total") * 100).otherwise(0.0))
    averages = dims.agg(*[F.coalesce(round2(F.avg(F.when(F.col("dim") == d, F.col("loose")))), F.lit(0.0)).alias(d) for d in cfg.dimensions])
    return head.crossJoin(averages)


def run_summary(corpus: DataFrame, classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """total is the number of inputs, so it may exceed passed + failed + invalid."""
    rows = corpus.select(key).join(classified.where("view_class <> 'dropped'").select(key, "view_class"), key, "left")
    return rows.agg(F.count_distinct(key).alias("total"), *[F.count_if(F.col("view_class") == c).alias(c) for c in ("passed", "failed", "invalid")])


def convert_stats(classified: DataFrame, parsed: DataFrame) -> DataFrame:
    """total, kept, low, skipped and, among kept, plain."""
    counts = classified.agg(F.count("*").alias("total"), *[F.count_if(F.col("convert_class") == c).alias(c) for c in ("kept", "low", "skipped")])
    return counts.crossJoin(parsed.agg(F.count_if(F.col("type") == "plain").alias("plain")))

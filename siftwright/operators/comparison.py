"""Generators against judges: score matrix, agreement of the judges, strengths from pairwise wins.

An own design: of the original's comparison command only its options are known.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrix(scores: DataFrame) -> DataFrame:
    """Of (generator, judge, score): generator, judge, n, mean and place (1 is the judge's best; equal means share a place)."""
    got = scores.where("score is not null").groupBy("generator", "judge").agg(F.count("*").alias("n"), (F.sum("score") / F.count("*")).alias("mean"))
    return got.withColumn("place", F.rank().over(Window.partitionBy("judge").orderBy(F.desc("mean"))).cast("int"))


def agreement(table: DataFrame) -> DataFrame:
    """judge_a, judge_b, n, correlation of their mean ranks (Spearman) over the generators that both scored; null without two of them or a spread."""
    w = Window.partitionBy("judge")
    # equal means get the mean of the places they fill
    ties = F.count("*").over(Window.partitionBy("judge", "mean"))
    ranked = table.select("judge", "generator", (F.col("place") + (ties - 1) / 2).alias("r"), F.count("*").over(w).alias("size"))
    a, b = (ranked.select("generator", F.col("judge").alias(f"judge_{x}"), F.col("r").alias(f"r_{x}")) for x in "ab")
    both = a.join(b, "generator").where("judge_a < judge_b")
    return both.groupBy("judge_a", "judge_b").agg(F.count("*").alias("n"), F.corr("r_a", "r_b").alias("correlation"))


def wins(scores: DataFrame) -> DataFrame:
    """Of (seed, generator, judge, score): a, b, games and points of a against b.

    Generators meet where a judge scored both on one seed, by the mean of their
    scores there; a draw is half a point.  Rows are first made one a seed, judge
    and generator, so pairs number at most the square of the generators.
    """
    one = scores.where("score is not null").groupBy("seed", "judge", "generator").agg((F.sum("score") / F.count("*")).alias("mean"))
    met = one.groupBy("seed", "judge").agg(F.array_sort(F.collect_list(F.struct("generator", "mean"))).alias("g"))
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.struct(x["generator"].alias("a"), y["generator"].alias("b"), F.when(x["mean"] > y["mean"], 1.0).when(x["mean"] < y["mean"], 0.0).otherwise(0.5).alias("p")))))
    return met.select(F.explode(pairs).alias("m")).groupBy("m.a", "m.b").agg(F.count("*").alias("games"), F.sum("m.p").alias("points"))


def strengths(won: DataFrame, steps: int = 100, least: float = 1e-12) -> DataFrame:
    """generator, games, points and strength by Bradley and Terry: a beats b with a's share of both strengths.

    Found by Newton's steps on the logarithms.  Each generator also draws once
    against an imagined one of strength 1, which fixes the scale and gives those
    that always win or lose a strength too.  The table of wins has the generators
    squared, whatever the corpus's size, and is collected.
    """
    rows = won.collect()
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    at = {n: i for i, n in enumerate(names)}
    games, points = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in rows:
        a, b = at[r.a], at[r.b]
        games[a, b] += r.games
        games[b, a] += r.games
        points[a] += r.points
        points[b] += r.games - r.points
    log = np.zeros(len(names))
    for _ in range(steps):
        win = 1 / (1 + np.exp(log[None, :] - log[:, None]))
        drawn = 1 / (1 + np.exp(-log))
        slope = points + 0.5 - (games * win).sum(1) - drawn
        bend = games * win * (1 - win)
        step = np.linalg.solve(np.diag(bend.sum(1) + drawn * (1 - drawn)) - bend, slope)
        log += np.clip(step, -1, 1)
        if np.abs(step).max(initial=0) < least:
            break
    p = np.exp(log)
    got = [(n, int(games[i].sum()), float(points[i]), float(p[i])) for n, i in at.items()]
    return won.sparkSession.createDataFrame(got, "generator string, games long, points double, strength double")

r"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled (by a hash of doc_id); a document's
virtual finish time is the words of its source up to and including it, divided
by the source's target.  A source may be read twice.  All documents are ordered
by finish time and the order is cut where the budget of words is used up, so at
any cut every source has had its share to within about one document.

Nothing sorts in one task: cumulative sums are taken inside small hash ranges
and joined to the ranges' own totals, and the cut is found by narrowing an
interval of finish times, as the level of the targets is by one of sources.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

WORDS = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"
#: interval parts for each step that narrows the cut, and the rows that are then ordered in one task
PARTS, LAST = 2048, 20_000


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with nth, the place (from 0) in code-point order, null last; counted apart in each part of a range partitioning."""
    by_name = F.col("source").asc_nulls_last()
    parts = stored(sources.repartitionByRange(by_name).withColumn("part", F.spark_partition_id()), "by-name")
    ahead = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    ahead = ahead.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1 + F.col("ahead")
    return stored(parts.join(F.broadcast(ahead), "part").withColumn("nth", nth).drop("part", "ahead"), "sources")


def _level(s: DataFrame, share: float) -> float:
    """The level at which min(cap, level * w) adds up to ``share`` of all sizes; s holds source_size, nth, w, cap and r = cap / w.

    Sources fill in the order of r.  The stretch of r that holds the level is
    narrowed until at most LAST sources, or those of one r, are left in it.
    """
    total, weight, hi = s.agg(F.sum("source_size"), F.sum("w"), F.max("r")).first()
    if total is None:
        return math.inf
    budget, full, lo, narrowed = total * share, 0.0, -1.0, False
    inside, held = s, weight  # held: weights of the stretch; weight: those beyond its beginning
    while inside.limit(LAST + 1).count() > LAST:
        width = (hi - lo) / PARTS
        if lo + width <= lo:
            break
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("r") - F.lit(lo)) / F.lit(width)).cast("int"))
        sums = inside.groupBy(part.alias("p")).agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.min("r").alias("a"), F.max("r").alias("b")).collect()
        for x in sorted(sums, key=lambda x: x.p):
            if full + x.cap + x.b * (weight - x.w) >= budget:
                break
            full, weight, lo = full + x.cap, weight - x.w, x.b
        else:
            return math.inf if not narrowed else hi
        if x.a == x.b:
            return (budget - full) / weight
        hi, held, narrowed = x.b, x.w, True
        inside = s.where((F.col("r") > lo) & (F.col("r") <= hi))
    order = Window.orderBy("r", "nth")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)) + F.lit(weight - held)
    levels = inside.select("r", "nth", ((F.lit(budget) - (F.lit(full) + before)) / after).alias("level"))
    found = levels.where("level <= r").agg(F.min(F.struct("r", "nth", "level"))["level"]).first()[0]
    return found if found is not None else hi if narrowed else math.inf


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with nth and target: weights repeat by source in code-point order, null last.

    Targets share ``share`` of all sizes by weight; none exceeds ``most`` times
    its source's size, and the excess goes to the others by weight.  One row
    per source; no task or driver holds all sources, however many there are.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = _numbered(sources.select("source", "source_size")).withColumn("w", w)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("r", F.col("cap") / F.col("w"))
    return s.select("source", "nth", "source_size", F.least("cap", F.lit(_level(s, share)) * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    r"""One row per document: doc_id, source, size, source_size, target, times, taken, finish (its first finish time).

    Size is the number of ``[^\x20\x09-\x0D]+`` in the text; a null text has
    none.  ``times`` is how often the mix takes the document (0 to 2) and
    ``taken`` its words.  Null is a source of its own and comes last.  Repeated
    rows and repeated or null doc_ids count as documents of their own, ties in
    the shuffle being settled by doc_id, size and the columns of ``keep``, which
    come out too (their names must not be among the above).  An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"), *keep)
    rows = stored(rows.select(*keep, "doc_id", "source", F.coalesce(F.expr(WORDS), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h")), "sizes")
    n = rows.count()
    digits = 1
    while n / 16**digits > LAST and digits < 6:
        digits += 1
    rows = rows.withColumn("cell", F.substring("h", 1, digits))
    cells = stored(rows.groupBy("source", "cell").agg(F.sum("size").alias("in_cell")), "cells")
    sources = targets(cells.groupBy("source").agg(F.sum("in_cell").alias("source_size")), weights, share, most)
    offsets = cells.withColumn("before", F.sum("in_cell").over(Window.partitionBy("source").orderBy("cell")) - F.col("in_cell"))
    known = offsets.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "cell", "before", "nth", "source_size", "target")
    known = known.withColumnsRenamed({"source": "source_", "cell": "cell_"})
    inside = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("cum", F.sum("size").over(inside))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("source_")) & (F.col("cell") == F.col("cell_"))).withColumn("cum", F.col("cum") + F.col("before"))
    finish = lambda turn: F.when(F.col("target") > 0, (F.lit(turn) * F.col("source_size") + F.col("cum")) / F.col("target"))
    placed = placed.withColumn("f0", finish(0)).withColumn("f1", finish(1))
    placed = stored(placed.select(*keep, "doc_id", "source", "size", "source_size", "target", "nth", "cum", "h", "f0", "f1"), "queue")

    turns = placed.select("nth", "h", "doc_id", "size", "cum", F.posexplode(F.array("f0", "f1")).alias("turn", "f")).where("f is not null and size > 0")
    limit, everything = _cut(turns, share, placed)
    times = F.lit(0)
    for turn in (0, 1):
        f = F.col(f"f{turn}")
        key = F.struct(f.alias("f"), F.col("nth").cast("long").alias("nth"), F.lit(turn).cast("long").alias("turn"), "cum")
        last = limit and F.struct(F.lit(limit[0]).alias("f"), *[F.lit(x).cast("long").alias(k) for k, x in zip(("nth", "turn", "cum"), limit[1:], strict=True)])
        taken = F.lit(True) if everything else F.lit(False) if limit is None else key <= last
        times = times + F.when(f.isNotNull() & taken, 1).otherwise(0)
    return placed.withColumn("times", times).select(*keep, "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), F.col("f0").alias("finish"))


def _cut(turns: DataFrame, share: float, placed: DataFrame) -> tuple[tuple | None, bool]:
    """The last (finish, source, turn, words) that the budget holds, or None; whether everything fits."""
    total = placed.agg(F.sum("size")).first()[0] or 0
    budget = int(total * share)
    lo, hi, used = 0.0, (turns.agg(F.max("f")).first()[0] or 0.0), 0
    while True:
        inside = turns.where((F.col("f") > lo) & (F.col("f") <= hi))
        width = (hi - lo) / PARTS
        if inside.limit(LAST + 1).count() <= LAST or lo + width <= lo:
            break
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("f") - F.lit(lo)) / F.lit(width)).cast("int"))
        stats = sorted(inside.groupBy(part.alias("p")).agg(F.sum("size").alias("s"), F.min("f").alias("a"), F.max("f").alias("b")).collect(), key=lambda r: r.p)
        below = lo
        for r in stats:
            if used + r.s > budget:
                break
            used, below = used + r.s, r.b
        else:
            return None, True
        if (below, r.b) == (lo, hi):
            break
        lo, hi = below, r.b
    order = Window.orderBy("f", "nth", "turn", "cum", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("all", F.sum("size").over(order) + used).where(F.col("all") <= budget)
    last = fits.agg(F.max(F.struct("f", "nth", "turn", "cum")).alias("m"), F.count("*").alias("n")).first()
    if last.n == 0:
        return ((lo, 2**31 - 1, 2**31 - 1, 2**62) if used else None), False
    return tuple(last.m), False

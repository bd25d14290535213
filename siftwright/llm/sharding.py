"""Size-balanced shards from sampled splitters; DataFrame functions only.

Rows are ordered by a hash of their text, so equal texts lie together.
Splitters are quantiles of a size-weighted sample of keys.  Ranges are counted
exactly and an overfull one is subdivided: by key, or, where one key alone
fills it (a hot group of copies), by a hash of doc_id, and where one doc_id
repeats that often too, by the rows' places.  Byte and row positions are
cumulative sums inside a range plus the ranges before it, so no task holds more
than a range and the law ``bytes`` is met exactly up to one document or one
small group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

#: sampled keys for each range; most ranges (the sample, on the driver, is about the product of the two)
SAMPLES, MOST_RANGES, ROWS = 16, 1 << 16, 200_000
#: a group of equal texts above this part of a shard may be split between shards
SPLIT_ABOVE = 0.1


def assign_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 8), text_crc32, shard, slot, position (in the global order).

    Shards are near equal in bytes.  Slots count from 0 without gaps inside a
    shard.  Equal texts share a shard unless they fill over ``SPLIT_ABOVE`` of
    one.  A null text has no bytes and lies with empty ones.  Repeated rows are
    placed apart, one slot each; a null doc_id sorts first among equal texts.
    Columns of ``keep`` come out too, and settle ties (their names must not be
    among the above).  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(*keep, F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t).cast("long") + 8).alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("h"))
    base = stored(base, "keys").withColumn("place", F.col("_metadata.row_index"))
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(8 * shards, math.ceil(n / ROWS)))
    m = ranges * SAMPLES
    # a row is drawn with probability min(1, size * m / total), by its hash: the same rows each time
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = base.where(draw < F.col("size") * F.lit(m / max(total, 1))).select("h", F.greatest("size", F.lit(total / m)).alias("weight"))
    sample = sorted(tuple(r) for r in drawn.groupBy("h").agg(F.sum("weight")).collect())
    bounds = _ranges(sample, ranges)
    schema = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("rid", T.IntegerType())])
    table = spark.createDataFrame([(lo, hi, i) for i, (lo, hi) in enumerate(bounds)], schema)
    cell = lambda c: F.shiftright(c, 50)  # noqa: E731  16,384 cells turn the range lookup into an equality
    lookup = F.broadcast(table.select("lo", "hi", "rid", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell")))
    rows = base.withColumn("cell", cell("h")).join(lookup, "cell").where("h >= lo and h <= hi")
    limit = 2 * max(total, 1) / ranges
    counted = rows.groupBy("rid").agg(F.sum("size").alias("held"))
    parts = counted.select("rid", F.ceil(F.col("held") / F.lit(limit)).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(parts), "rid")
    by_key = F.floor((F.col("h").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double")) * F.col("parts"))
    sub = F.when(F.col("parts") == 1, 0).when(F.col("lo") == F.col("hi"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts"))).otherwise(F.least(F.col("parts") - 1, by_key)).cast("int")
    rows = rows.withColumn("sub", sub).withColumn("alone", (F.col("lo") == F.col("hi")) & (F.col("parts") > 1)).select(*keep, "rid", "sub", "alone", "h", "crc", "size", "doc_id", "place")
    rows = stored(rows, "ranged")
    # equal or null doc_ids share a sub: one that is still overfull is dealt by place
    heavy = rows.where("alone").groupBy("rid", "sub").agg(F.ceil(F.sum("size") / F.lit(2 * limit)).cast("int").alias("pieces")).where("pieces > 1")
    piece = F.coalesce(F.pmod(F.xxhash64("place", F.lit(seed)), F.col("pieces")).cast("int"), F.lit(0))
    rows = rows.join(F.broadcast(heavy), ["rid", "sub"], "left").withColumn("piece", piece).drop("pieces", "place")

    bins = rows.groupBy("rid", "sub", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ahead = Window.orderBy("rid", "sub", "piece").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("rid", "sub", "piece", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    own = Window.partitionBy("rid", "sub", "piece").orderBy("h", "crc", "size", "doc_id", *keep).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("size").over(own) - F.col("size")).withColumn("rank", F.row_number().over(own) - 1)
    group = Window.partitionBy("rid", "sub", "piece", "h", "crc", "size")
    rows = rows.withColumn("g_start", F.min("start").over(group)).withColumn("g_size", F.sum("size").over(group))
    rows = rows.join(F.broadcast(bins), ["rid", "sub", "piece"])
    whole = ~F.col("alone") & (F.col("g_size") <= F.lit(SPLIT_ABOVE * total / shards))
    twice = F.lit(2) * F.col("b0") + F.when(whole, 2 * F.col("g_start") + F.col("g_size")).otherwise(2 * F.col("start") + F.col("size"))
    # whole numbers: a double would round beyond 2**53
    rows = rows.withColumn("twice", twice).withColumn("shard", F.expr(f"cast(least({shards - 1}, twice * {shards}L div {2 * max(total, 1)}L) as int)"))
    rows = stored(rows.select(*keep, "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("n0") + F.col("rank")).alias("position")), "placed")
    first = rows.groupBy("shard").agg(F.min("position").alias("first"))
    return rows.join(F.broadcast(first), "shard").select(*keep, "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"), "position")


def _ranges(sample: list[tuple[int, float]], ranges: int) -> list[tuple[int, int]]:
    """Inclusive ranges that cover all keys, about equal in sampled weight; a key of a range's weight has its own."""
    least, most = -(1 << 63), (1 << 63) - 1
    each = sum(w for _, w in sample) / ranges if sample else 1.0
    out, lo, held = [], least, 0.0
    for h, w in sample:
        if w >= each:
            if lo < h:
                out.append((lo, h - 1))
            out.append((h, h))
            lo, held = h + 1, 0.0
        elif (held := held + w) >= each:
            out.append((lo, h))
            lo, held = h + 1, 0.0
    if lo <= most:
        out.append((lo, most))
    return out

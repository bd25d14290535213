r"""Cross-site boilerplate lines, by the number of distinct sites that hold a line; DataFrame functions only.

Each line hash gets a HyperLogLog sketch of its sites; sketches merge by
aggregation, so a line of a third of all documents reaches the shuffle as one
sketch a task.  Lines whose estimate lies within ``MARGIN`` of the threshold
are counted exactly, after a bitmap of fixed size has dropped the others and
each task has dropped its repetitions.  A document's removed lines come back as
an array of hashes and are filtered out of its text in place; the list of
removed lines is repeated under ``SALTS`` salts, so that the occurrences of a
common one are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, tested
from .storage import stored

#: estimates from (1 - MARGIN) * threshold - 1 to (1 + MARGIN) * threshold + 1 are counted again; with 2**LG_K registers an error that large is over 6 standard errors out
MARGIN, LG_K = 0.2, 10
SALTS = 16


def _key(line):
    """96 bits of hash name a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(docs: DataFrame, sites: int = 5, text: str = "text", site: str = "source", least_chars: int = 1) -> DataFrame:
    """Hashes (line: a, b) and site counts of lines of at least ``least_chars`` characters (without outer blanks) found at ``sites`` sites or more.

    ``n_sites`` is exact near the threshold and an estimate farther off.  A
    null site is no site.  Lines end at line feeds.
    """
    lines = docs.where(F.col(site).isNotNull()).select(F.col(site).cast("string").alias("site"), F.explode(F.array_distinct(F.split(F.col(text).cast("string"), "\n"))).alias("line"))
    lines = lines.where(F.length(F.trim("line")) >= least_chars).select(_key(F.col("line")).alias("line"), "site")
    # a line of one site is no candidate: minimum and maximum tell without a sketch
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    if sites > 1:
        sketched = sketched.where("lo < hi")
    estimates = stored(sketched.select("line", F.hll_sketch_estimate("sketch").alias("n")), "estimates")
    low, high = (1 - MARGIN) * sites - 1, (1 + MARGIN) * sites + 1
    near = stored(estimates.where(F.col("n").between(low, high)).select("line"), "near")
    # each task's repetitions go before anything is shuffled
    held = tested(lines, bitmap(near, "line"), "near", "line").where("near").select("line", "site").distinct()
    exact = held.join(near, "line", "left_semi").groupBy("line").agg(F.count("*").alias("n_sites"))
    sure = estimates.where(F.col("n") > high).select("line", F.col("n").alias("n_sites"))
    return exact.where(F.col("n_sites") >= sites).unionByName(sure)


def drop_boilerplate(docs: DataFrame, sites: int = 5, doc_id: str = "doc_id", text: str = "text", site: str = "source", least_chars: int = 1) -> DataFrame:
    r"""One row per document: doc_id, n_lines, n_removed, kept (the other lines, joined by line feeds).

    Every line that boilerplate() names goes from every document, whatever its
    site.  A null text stays null with 0 lines.  Rows that share doc_id and
    text have equal results and come out as often as they came in; a null
    doc_id takes part.  An empty table gives an empty result; other columns are
    ignored.
    """
    found = stored(boilerplate(docs, sites, text, site, least_chars), "boilerplate")
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text")).withColumn("th", _key(F.coalesce(F.col("text"), F.lit(""))))
    held = rows.select("doc_id", "th", F.explode(F.array_distinct(F.split("text", "\n"))).alias("text")).select("doc_id", "th", _key(F.col("text")).alias("line"))
    held = tested(held, bitmap(found, "line"), "found", "line").where("found").withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int"))
    salted = found.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = held.join(salted, ["line", "salt"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("doc_id_"), F.col("th").alias("th_"), "gone")
    out = rows.join(gone, rows.doc_id.eqNullSafe(gone.doc_id_) & (rows.th == gone.th_), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("gone", _key(x))))
    out = out.select("doc_id", "text", lines.alias("lines"), kept.alias("left"))
    return out.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("left", "\n").alias("kept"))

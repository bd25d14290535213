"""From raw documents to balanced training shards: five stages, each an operator of siftwright.llm.

A stage takes (spark, docs, sf_dir); what it returns is written and read again
as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import decontam, mixing, ngram_join, quality, sharding
from siftwright.llm.storage import free, identified, stored

#: a document below this score is rejected
LEAST_SCORE = 0.7
SHARDS = 24


def _plain(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Only the text is judged: a null text counts as empty, equal texts share
    their fate, repeated rows and rows with a null doc_id stay apart.  Further
    columns are kept, whatever their names; an empty table stays empty.
    """
    score, = free(docs.columns, "score")
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~quality.held_out())
    scored = quality.score_documents(docs, trees, score=score)
    return _plain(scored.where(F.col(score) >= LEAST_SCORE), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 stays: the smallest doc_id.

    A null doc_id counts as largest, ties go to the smaller text hash, and of
    rows that repeat a doc_id and its text one stays.  Null and empty texts and
    those of spaces only are linked with nothing and all stay.  Further columns
    are kept, whatever their names; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark words go.

    Each row is judged by its own text; one without words stays, null ones
    included, and repeated rows or null doc_ids make no difference.  Further
    columns are kept, whatever their names; an empty table stays empty.
    """
    row, = free(docs.columns, "row")
    rows = identified(docs, row)
    bad = decontam.contaminated_ids(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=13, share=20, doc_id=row, id_type="string").withColumnRenamed("doc_id", row)
    return _plain(rows.join(bad, row, "left_anti"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 (repeating), 150 % of all words: a document comes up to twice, or not at all.

    Every row counts as a document of its own, rows that repeat others or have
    a null doc_id too; a null source is a source and comes last.  Ties in the
    order are settled by doc_id, size and all columns.  A text without words,
    null ones included, takes no room and is not taken.  Further columns are
    kept, whatever their names; an empty table stays empty.
    """
    row, tie, times, copy = free([*docs.columns, "doc_id", "source", "size", "source_size", "target", "taken", "finish"], "row", "tie", "times_", "copy")
    rows = identified(docs.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])), row)
    taken = mixing.mix_sources(rows, weights=(5, 2, 1), share=1.5, most=2.0, keep=(tie, row))
    taken = taken.where("times > 0").select(row, F.col("times").cast("int").alias(times))
    copies = rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return _plain(copies, docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with size (UTF-8 bytes + 8), text_crc32, shard and slot; shards are near equal in bytes.

    A null text has no bytes; rows that repeat others get a slot each and a
    null doc_id comes first among equal texts.  Further columns are kept; one
    named like a new one comes out with an underscore before its name.  An
    empty table stays empty.
    """
    new = ["size", "text_crc32", "shard", "slot"]
    apart = [c if c.lower() not in new else free([*docs.columns, *new], c)[0] for c in docs.columns]
    docs = docs.toDF(*apart)
    row, = free([*docs.columns, "doc_id", *new, "position"], "row")
    rows = identified(docs, row)
    placed = sharding.assign_shards(rows, shards=SHARDS, keep=(row,)).select(row, *new)
    return rows.join(placed, row).select(*[F.col(f"`{c}`") for c in docs.columns], *new)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: trees fitted on the data are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

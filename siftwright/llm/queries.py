"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, linededup, mixing, ngram_join, quality, repair, sharding, substring, toxicity, vectorcodes, warc, wordpiece
from .storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.link_sets(table(spark, sf_dir, "documents"), n=4, percent=85)
    return out.select("doc_id", F.col("n_shingles").cast("long"), "component_id", "links")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, table(spark, sf_dir, "labels"), learn=~quality.held_out())
    out = quality.score_documents(docs, trees)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13, share=20)
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", F.col("n_words").cast("long"), "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(table(spark, sf_dir, "documents"), sites=5)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), wordpiece.load_vocabulary(vocabulary))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), k=20)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out())
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = repair.repair(repair.damaged(rows))
    ids = rows.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", repair.key(F.col("conv_id")).alias("conv"))
    out = ids.join(done.summary, "conv", "left").join(repair.digests(done.turns), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", nothing).alias("repaired_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"), carry=("label",))
    rows = stored(codes, "vector-codes")
    # sums of labels are made where rows are read; a label that holds a third of all rows reaches the shuffle as one sum a task
    sums = stored(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total")), "label-errors")
    sums = sums.select(F.col("label").alias("label_"), F.least("total", F.lit(vectorcodes.LONG)).cast("long").alias("label_error"))
    out = rows.join(sums, rows.label.eqNullSafe(sums.label_))
    spelled = F.lower(F.hex("codes"))
    listed = hashlib.sha256(vectorcodes.listed(books).encode()).hexdigest()
    return out.select("vec_id", spelled.alias("code"), "error", "label_error", F.lit(listed).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_warc,
        op3_mixing,
        op4_quality,
        op5_nearest_neighbours,
        op6_decontamination,
        op7_line_dedup,
        op8_token_counts,
        op9_sharding,
        op10_substring_dedup,
        op11_toxicity,
        op12_conversation_repair,
        op13_vector_codes,
    )
}

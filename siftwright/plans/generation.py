"""Synthetic data: who writes what from which seed, grown generation by generation.

An own design: of the original's generation command only the paradigms, models
and options are known.  A lineage starts from a seed text in one paradigm with
one model; generation g is written from what generation g - 1 of its lineage
said.  Each generation is stored before the next is asked for, so a run that is
killed goes on where it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.judging import Judge

# fixed values: names of the paradigms and models
PARADIGMS = ("self_instruct", "evol_instruct", "magpie", "seed_rewrite")
MODELS = ("deepseek", "glm", "qwen")
ASKS = {
    "self_instruct": "Read the example and write a new task of the same kind with its answer.\n\n{text}",
    "evol_instruct": "Make the following task harder by one step, then solve it.\n\n{text}",
    "magpie": "Continue as the user who would ask for this, then answer.\n\n{text}",
    "seed_rewrite": "Say the following again in other words, keeping every fact.\n\n{text}",
}


@dataclass(frozen=True)
class GenerationConfig:
    paradigms: tuple[str, ...] = PARADIGMS
    models: tuple[str, ...] = MODELS
    generations: int = 2
    per_seed: int = 1

    def __post_init__(self) -> None:
        unknown = set(self.paradigms) - set(ASKS)
        if unknown or self.generations < 1 or self.per_seed < 1:
            raise ValueError(f"no such paradigm: {sorted(unknown)}" if unknown else "generations and per_seed must be at least 1")


def lineages(seeds: DataFrame, cfg: GenerationConfig, seed_id: str = "doc_id") -> DataFrame:
    """lineage, seed_id, paradigm, model, nth: seeds x paradigms x models x times; all but the seeds is configuration and is broadcast."""
    spark = seeds.sparkSession
    ways = spark.createDataFrame([(p, m, n) for p in cfg.paradigms for m in cfg.models for n in range(1, cfg.per_seed + 1)], "paradigm string, model string, nth int")
    out = seeds.crossJoin(F.broadcast(ways))
    return out.withColumn("lineage", F.concat_ws("/", F.col(seed_id).cast("string"), "paradigm", "model", F.col("nth").cast("string")))


def plan(seeds: DataFrame, cfg: GenerationConfig, seed_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The dry run: every call of every generation (lineage, generation, parent, seed, paradigm, model), and the prompt where it is known, which is the first generation's."""
    start = lineages(seeds.where(F.trim(text) != "").select(seed_id, text), cfg, seed_id)
    steps = start.withColumn("generation", F.explode(F.sequence(F.lit(1), F.lit(cfg.generations))))
    parent = F.when(F.col("generation") > 1, F.concat_ws("#", "lineage", (F.col("generation") - 1).cast("string")))
    prompt = F.when(F.col("generation") == 1, _prompt(F.col(text)))
    return steps.select("lineage", "generation", parent.alias("parent"), F.col(seed_id).alias("seed"), "paradigm", "model", prompt.alias("prompt"))


def _prompt(text):
    asks = F.create_map(*[F.lit(x) for kv in ASKS.items() for x in kv])
    return F.replace(F.element_at(asks, F.col("paradigm")), F.lit("{text}"), text)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def grow(seeds: DataFrame, writer: Judge, cfg: GenerationConfig, path: str, seed_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All generations (lineage, generation, seed, paradigm, model, prompt, raw, error) under ``path``.

    What is stored is not written again: only lineages without an answer of a
    generation are asked for it.  One whose parent failed, or said nothing,
    ends there.  Each task's answers are committed when the task ends.
    """
    spark = seeds.sparkSession
    now = lineages(seeds.where(F.trim(text) != "").select(seed_id, text), cfg, seed_id).select("lineage", F.col(seed_id).alias("seed"), "paradigm", "model", F.col(text).alias("text"))
    out = None
    for g in range(1, cfg.generations + 1):
        where = f"{path}/generation={g}"
        had = _stored(spark, where)
        left = now if had is None else now.join(had.select("lineage"), "lineage", "left_anti")
        tasks = left.select("lineage", "seed", "paradigm", "model", F.lit(None).cast("string").alias("system_prompt"), _prompt(F.col("text")).alias("prompt"))
        answers = writer.answer(tasks).select("lineage", "seed", "paradigm", "model", "prompt", "raw", "error")
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", 2).parquet(where)
        rows = spark.read.schema(answers.schema).parquet(where)
        one = rows.withColumn("generation", F.lit(g))
        out = one if out is None else out.unionByName(one)
        now = rows.where("error is null and trim(raw) <> ''").select("lineage", "seed", "paradigm", "model", F.col("raw").alias("text"))
    return out

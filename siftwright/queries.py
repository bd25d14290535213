"""Registered queries: each runs one operator over whole tables, with the synthetic judge where answers are needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EvalConfig
from .functions.pytext import splitlines, strip
from .functions.score import extract_reason
from .operators import comparison, curation, evaluate, parse, reports, stats
from .operators.judging import ReplayJudge, SyntheticJudge
from .plans import generation
from .sources import corpus, splits
from .sources import reports as files
from .storage import fresh_path

CFG = EvalConfig()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def judgments(spark: SparkSession, sf_dir: str, rounds: list[int] | None = None) -> DataFrame:
    """Synthetic judgments; texts are not carried along."""
    grid = evaluate.task_grid(documents(spark, sf_dir, "doc_id", "n_chars"), CFG, rounds)
    return evaluate.judge_rows(SyntheticJudge().answer(grid))


def last_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dim_scores(judgments(spark, sf_dir, [CFG.rounds]))


def finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.final_scores(last_scores(spark, sf_dir), CFG)


def structured_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: all conversations as marked lines (odd turns of every third one are the user's too, so that neighbours share a role), as instruction texts, and documents as they are."""
    turns = table(spark, sf_dir, "conversations")
    role = F.expr("case when conv_id % 3 = 1 and turn % 2 = 1 then 'user' else role end")
    talk = turns.select("conv_id", "turn", F.concat(role, F.lit(": "), "text").alias("line"))
    marks = F.expr("case turn % 3 when 0 then 'instruction: ' when 1 then 'input：' else 'OUTPUT : ' end")
    asked = turns.select((F.col("conv_id") + 1_000_000).alias("conv_id"), "turn", F.concat(marks, "text").alias("line"))
    joined = talk.union(asked).groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("t"))
    joined = joined.select("id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))
    return joined.union(documents(spark, sf_dir, (F.col("doc_id") + 2_000_000).alias("id"), "text"))


def marked_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, report: JSON strings with numbers, booleans, strings, nulls, NaN, missing keys, values that are no objects, whole texts; a control character wherever white space may stand."""
    text = F.get_json_object(F.to_json(F.struct(F.concat(F.expr("case when doc_id % 2 = 0 then 'user: ' else '' end"), F.coalesce("text", F.lit(""))).alias("t"))), "$")
    quoted = F.regexp_extract(text, r'(?s)^\{"t":(.*)\}$', 1)
    return documents(spark, sf_dir, "doc_id", quoted.alias("quoted")).select(
        "doc_id",
        F.expr("""
        case when doc_id % 14 = 13 then '[1, 2]' else concat(
          '{~"meta": {~"text": ', quoted, '}, ~"final": ',
          case when doc_id % 14 = 12 then 'null' else concat(
            '{~', case when doc_id % 5 = 0 then '"passed": true, ' else '' end,
            case doc_id % 14 when 10 then '' when 7 then '"overall_score": true, ' when 8 then '"overall_score": "7", ' when 9 then '"overall_score": null, ' when 11 then '"overall_score": NaN, '
              when 6 then concat('"overall_score": ', doc_id * 37 % 101 div 10, ', ')
              else concat('"overall_score": ', doc_id * 37 % 101 div 10, '.', doc_id * 37 % 101 % 10, ', ') end,
            '~"dimension_scores": {~"safety": ', doc_id * 13 % 41 / 4, ', ~"accuracy": ', case when doc_id % 7 = 0 then 'true' else string(doc_id % 11) end,
            ', ~"diversity": ', string(doc_id * 29 % 1001 / 10D), ', ~"format": ', string(doc_id * 17 % 400 / 8D - 25),
            ', ~"style": ', case when doc_id % 3 = 0 then '"x"' else string(doc_id * 5 % 41 / 4) end, '}}') end,
          ', ~"rounds": [~', array_join(transform(sequence(1, 2), r -> concat('{~"round": ', r, ', ~"dimensions": {~"safety": {~',
            array_join(transform(sequence(0, 2), m -> concat('"m', m, '": {~"score": ', case when (doc_id + r + m) % 5 = 0 then 'null' when (doc_id + m) % 17 = 0 then 'true' else string((doc_id * (r + 2) + m * 7) % 41 / 4) end, '}')), ', ~'), '}}}')), ', ~'),
          '~]}') end""".replace("~", "\x01")).alias("report"),
    )


def dirty_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, report on one line."""
    return marked_reports(spark, sf_dir).withColumn("report", F.replace("report", F.lit("\x01"), F.lit("")))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.classify(dirty_reports(spark, sf_dir), CFG.threshold)


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, content: dirty reports grouped in files of JSON lines (with blank lines), arrays (indented) and single indented objects."""
    rows = marked_reports(spark, sf_dir).withColumn("file", F.expr("case doc_id % 3 when 0 then concat('lines-', doc_id div 30, '.jsonl') when 1 then concat('array-', doc_id div 30, '.json') else concat('one-', doc_id, '.json') end"))
    rows = rows.withColumn("report", F.replace("report", F.lit("\x01"), F.expr("case when doc_id % 3 = 0 then '' else '\n  ' end")))
    got = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("doc_id", "report"))).alias("r")).withColumn("r", F.transform("r", lambda x: x["report"]))
    return got.select("file", F.expr("case when file like 'lines-%' then concat('\n', array_join(r, '\n\n'), '\n') when file like 'array-%' then concat('[', array_join(r, ', '), ']') else r[0] end").alias("content"))


#: lines that are not JSON, though they begin like it
HOSTILE = ("{broken", '{"a": 1} trailing', '{"b": 2}{"c": 3}', '"meta": {', "1 2")


# sources and text functions


@query
def src_lines(spark, sf_dir):
    return corpus.items(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "item", "tag", F.md5("line").alias("line_md5"))


@query
def src_whole_doc(spark, sf_dir):
    return corpus.whole(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "text_length", F.md5("text").alias("text_md5"))


@query
def text_strip(spark, sf_dir):
    padded = F.concat(F.lit(" 　\t"), "text", F.lit(" \x1c\n "))
    return documents(spark, sf_dir, "doc_id", strip(padded).alias("t")).select("doc_id", F.md5("t").alias("text_md5"))


@query
def text_lines(spark, sf_dir):
    mixed = F.concat("text", F.lit("\x0bvt ls\r\ncrlf\x85nel\n"))
    return documents(spark, sf_dir, "doc_id", F.posexplode(splitlines(mixed)).alias("pos", "line")).select("doc_id", "pos", F.md5("line").alias("line_md5"))


@query
def text_length(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", F.length("text").alias("text_length"))


@query
def prompts_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_no"), F.to_json(F.struct(F.concat(F.lit("n"), F.col("item_id") % 7).alias("name"), F.col("text").alias("prompt_template"))).alias("line"))
    return corpus.prompts_of(rows).select("name", F.md5("prompt_template").alias("template_md5"))


@query
def prompts_missing_dims(spark, sf_dir):
    names = F.array(*[F.lit(d) for d in CFG.dimensions])
    have = table(spark, sf_dir, "benchmark").select(F.get(names, (F.col("item_id") % 3).cast("int")).alias("name")).distinct()
    return corpus.missing_dimensions(have, CFG.dimensions)


# evaluation


@query
def task_grid(spark, sf_dir):
    return evaluate.task_grid(documents(spark, sf_dir, "doc_id"), CFG).select("doc_id", "round", "dim", "model")


def _prompts(spark):
    return corpus.check_prompts(corpus.read_prompts(spark, CFG.prompts), CFG.dimensions)


@query
def prompt_render_r1(spark, sf_dir):
    rows = evaluate.prompt_rows(documents(spark, sf_dir, "doc_id", "text"), _prompts(spark), CFG)
    return rows.select("doc_id", "dim", F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


@query
def prompt_refine(spark, sf_dir):
    told = evaluate.with_feedback(documents(spark, sf_dir, "doc_id", "text"), judgments(spark, sf_dir, [1]))
    rows = evaluate.prompt_rows(told, _prompts(spark), CFG)
    return rows.select("doc_id", "dim", F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


@query
def judge_replay(spark, sf_dir):
    answers = judgments(spark, sf_dir).where("raw is not null").select("doc_id", "round", "dim", "model", "raw")
    grid = evaluate.task_grid(documents(spark, sf_dir, "doc_id"), CFG)
    return evaluate.judge_rows(ReplayJudge(answers).answer(grid)).select("doc_id", "round", "dim", "model", "raw", "score", "error")


@query
def judge_errors(spark, sf_dir):
    rows = judgments(spark, sf_dir).where("error is not null")
    return rows.groupBy("dim", "model", "error").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "").alias("without_reason"))


@query
def score_extract(spark, sf_dir):
    return judgments(spark, sf_dir).select("doc_id", "round", "dim", "model", "score")


@query
def reason_extract(spark, sf_dir):
    raw = F.expr("""case doc_id % 4
        when 0 then concat('精炼理由：', text, '\n完整分析：x\n分数：[[8]]')
        when 1 then concat(text, ' [[7.5]] tail')
        when 2 then concat('精炼理由: 。', text, '。；分数：[[3]]')
        else concat('精炼理由： 。[[4]]', text) end""")
    return documents(spark, sf_dir, "doc_id", raw.alias("raw")).select("doc_id", extract_reason(F.col("raw")).alias("reason"))


@query
def eval_dim_scores(spark, sf_dir):
    return last_scores(spark, sf_dir).select("doc_id", "dim", "score")


@query
def eval_final(spark, sf_dir):
    return finals(spark, sf_dir)


@query
def eval_contributions(spark, sf_dir):
    return evaluate.contributions(last_scores(spark, sf_dir), CFG).select("doc_id", "label", "score", "percent", "part")


@query
def eval_round_trend(spark, sf_dir):
    out = evaluate.round_trend(judgments(spark, sf_dir), CFG)
    return out.select("doc_id", "dim", *[F.get("trend", F.lit(i)).alias(f"r{i + 1}") for i in range(CFG.rounds)])


@query
def eval_trend(spark, sf_dir):
    return evaluate.round_trend(judgments(spark, sf_dir), CFG).select("doc_id", "dim", evaluate.arrow(F.col("trend")).alias("arrow"))


@query
def filter_passed(spark, sf_dir):
    return finals(spark, sf_dir).where("passed").select("doc_id", "overall_score")


# structure and conversion


@query
def parse_turns(spark, sf_dir):
    rows = parse.parse(structured_texts(spark, sf_dir)).select("id", F.posexplode("turns").alias("ord", "t"))
    return rows.select("id", "ord", "t.role", F.md5("t.value").alias("value_md5"))


@query
def parse_alpaca(spark, sf_dir):
    rows = parse.parse(structured_texts(spark, sf_dir)).where("type = 'alpaca'")
    return rows.select("id", *[F.md5(f).alias(f"{f}_md5") for f in ("instruction", "input", "output")])


@query
def parse_type(spark, sf_dir):
    return parse.parse(structured_texts(spark, sf_dir)).select("id", "type")


@query
def convert_alpaca(spark, sf_dir):
    rows = parse.to_alpaca(parse.parse(structured_texts(spark, sf_dir)))
    return rows.select("id", *[F.md5(f).alias(f"{f}_md5") for f in ("instruction", "input", "output")])


@query
def convert_sharegpt(spark, sf_dir):
    rows = parse.to_sharegpt(parse.parse(structured_texts(spark, sf_dir))).select("id", F.posexplode("conversations").alias("ord", "m"))
    return rows.select("id", "ord", F.col("m.from").alias("speaker"), F.md5("m.value").alias("value_md5"))


@query
def convert_stats(spark, sf_dir):
    rows = classified(spark, sf_dir)
    return stats.convert_stats(rows, parse.parse(rows.where("convert_class = 'kept'").select("doc_id", "text")))


# reports


@query
def report_nested(spark, sf_dir):
    j = judgments(spark, sf_dir)
    nested = reports.nested(documents(spark, sf_dir, "doc_id", "text"), j, finals(spark, sf_dir), evaluate.round_trend(j, CFG), CFG)
    text = reports.as_json(nested).select("doc_id", "report")
    get = lambda path, kind: F.try_variant_get(F.parse_json("report"), path, kind)
    return text.select(
        "doc_id",
        get("$.meta.text_length", "int").alias("text_length"),
        get("$.final.overall_score", "double").alias("overall_score"),
        get("$.final.conclusion", "string").alias("conclusion"),
        get("$.final.dimension_scores.format", "double").alias("format_score"),
        get("$.rounds[2].round", "int").alias("third_round"),
        get(f"$.rounds[0].dimensions.safety['{CFG.models[0][1]}'].score", "double").alias("first_score"),
        get("$.final.round_trend.diversity[1]", "double").alias("second_diversity"),
        F.regexp_count("report", F.lit('"error":"')).alias("n_errors"),
        F.regexp_count("report", F.lit('"error":')).alias("n_error_keys"),
        F.md5(get("$.meta.text", "string")).alias("text_md5"),
    )


@query
def reports_merge(spark, sf_dir):
    rows = finals(spark, sf_dir).select(F.col("doc_id").alias("ord"), "overall_score")
    return files.merge(rows.where("overall_score >= 5"), rows.where("overall_score < 5"), rows.where("overall_score is null").select("ord"))


@query
def reports_flatten(spark, sf_dir):
    return reports.flatten(dirty_reports(spark, sf_dir)).select("doc_id", "round", "dim", "model", "score")


@query
def reports_scan_strict(spark, sf_dir):
    return files.explode_files(report_files(spark, sf_dir)).groupBy("file").agg(F.count("*").alias("n"))


@query
def reports_scan_objects(spark, sf_dir):
    return files.explode_files(report_files(spark, sf_dir), objects=True).groupBy("file").agg(F.count("*").alias("n"))


@query
def reports_scan_lenient(spark, sf_dir):
    bad = F.lit("\n" + "\n".join(HOSTILE) + "\n")
    broken = report_files(spark, sf_dir).withColumn("content", F.when(F.col("file").endswith(".jsonl"), F.concat("content", bad)).otherwise(F.col("content")))
    return files.explode_files(broken, strict=False).groupBy("file").agg(F.count("*").alias("n"))


@query
def reports_scan_scores(spark, sf_dir):
    """What stands in reports of every kind of file, NaN included, is what was written."""
    rows = files.explode_files(report_files(spark, sf_dir), objects=True)
    seen = reports.classify(rows, CFG.threshold)
    return seen.groupBy("convert_class", "view_class").agg(F.count("*").alias("n"), F.count_if(F.isnan("overall")).alias("nan"), F.round(F.sum(F.when(~F.isnan("overall"), F.col("overall"))), 6).alias("total"), F.sum(F.length("text")).alias("chars"))


@query
def jsonl_preview(spark, sf_dir):
    """The first lines of files that hold all reports, thirty a file, after two lines that are no JSON."""
    rows = dirty_reports(spark, sf_dir).groupBy(F.expr("concat('lines-', doc_id div 30, '.jsonl')").alias("file")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "report"))).alias("r"))
    text = F.concat(F.lit("not json\n" + HOSTILE[1] + "\n\n"), F.array_join(F.transform("r", lambda x: x["report"]), "\n\n"), F.lit("\n"))
    return files.preview(rows.select("file", text.alias("content")), limit=10).groupBy("file").agg(F.count("value").alias("n_values"), F.count("raw").alias("n_raw"), F.max("pos").alias("last_pos"))


# statistics


@query
def viz_summary(spark, sf_dir):
    return stats.summary(classified(spark, sf_dir))


def _dims(spark, sf_dir):
    return reports.dimension_rows(dirty_reports(spark, sf_dir).withColumnRenamed("doc_id", "ord"))


@query
def viz_dim_avg(spark, sf_dir):
    return stats.dim_table(_dims(spark, sf_dir), CFG).select("place", "label", F.round("average", 9).alias("average"), "n")


@query
def viz_dim_buckets(spark, sf_dir):
    return stats.dim_table(_dims(spark, sf_dir), CFG).select("dim", "low", "middle", "high")


@query
def viz_model_consistency(spark, sf_dir):
    rows = reports.flatten(dirty_reports(spark, sf_dir).withColumnRenamed("doc_id", "ord"))
    out = stats.model_table(rows)
    return out.select("model", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "mean_diff")])


@query
def viz_bars(spark, sf_dir):
    return stats.bars(stats.dim_table(_dims(spark, sf_dir), CFG)).select("dim", "bar")


@query
def web_summary(spark, sf_dir):
    return stats.web_summary(classified(spark, sf_dir), _dims(spark, sf_dir), CFG)


@query
def pipeline_summary(spark, sf_dir):
    return stats.run_summary(documents(spark, sf_dir, "doc_id"), classified(spark, sf_dir))


@query
def history_topk(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"), F.col("event_type").alias("page"), F.repeat("props", 100).alias("log"))
    return corpus.latest_runs(runs).select("place", "id", "page", "log")


# files: written by the query into the shared folder, then read

#: documents in one file
IN_A_FILE = 500


def _folder(spark, name: str, rows: DataFrame, part: str) -> str:
    """Rows (``part``, value), in order, as one text file a part; the path that finds them all."""
    path = fresh_path(spark, name)
    rows.write.partitionBy(part).text(path)
    return f"{path}/*/*.txt"


def _of(column: str, part: str):
    return F.regexp_extract(column, f"{part}=([^/]+)/", 1)


@query
def corpus_files(spark, sf_dir):
    """Items of corpus files that hold all documents, each file read by as many tasks as it has blocks."""
    rows = documents(spark, sf_dir, "doc_id", F.expr(f"doc_id div {IN_A_FILE}").alias("part"), F.col("text").alias("value"))
    where = _folder(spark, "corpus", rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value"), "part")
    got = corpus.tagged(splits.items(spark, where))
    return got.select(_of("file", "part").cast("long").alias("part"), "item", "tag", F.md5("line").alias("line_md5"))


def _report_folder(spark, sf_dir, broken: bool = False) -> str:
    """Every report twice: in files of JSON lines and in indented arrays."""
    part = F.expr(f"doc_id div {IN_A_FILE}").alias("part")
    rows = marked_reports(spark, sf_dir).groupBy(part).agg(F.array_sort(F.collect_list(F.struct("doc_id", "report"))).alias("r"))
    rows = rows.select("part", "r", F.explode(F.array(F.lit("lines"), F.lit("array"))).alias("kind"))
    lines = F.col("kind") == "lines"
    file = F.concat("kind", F.lit("-"), F.col("part").cast("string"), F.when(lines, ".jsonl").otherwise(".json"))
    got = rows.select(file.alias("file"), F.transform("r", lambda x: F.replace(x["report"], F.lit("\x01"), F.when(lines, "").otherwise("\n  "))).alias("r"))
    bad = F.lit("\n" + "\n".join(HOSTILE) + "\n" if broken else "")
    text = F.when(F.col("file").startswith("lines"), F.concat(bad, F.array_join("r", "\n\n"))).otherwise(F.concat(F.lit("["), F.array_join("r", ", "), F.lit("]")))
    return _folder(spark, "reports", got.select("file", text.alias("value")), "file")


@query
def report_files_strict(spark, sf_dir):
    rows = files.read_reports(spark, _report_folder(spark, sf_dir))
    return rows.groupBy(_of("file", "file").alias("name")).agg(F.count("*").alias("n"), F.max("ord").alias("last"))


@query
def report_files_lenient(spark, sf_dir):
    rows = files.read_reports(spark, _report_folder(spark, sf_dir, broken=True), "lenient")
    return rows.groupBy(_of("file", "file").alias("name")).agg(F.count("*").alias("n"))


@query
def report_files_scores(spark, sf_dir):
    """What is read from files is what was written, whole texts and NaN included."""
    seen = reports.classify(files.read_reports(spark, _report_folder(spark, sf_dir), "objects"), CFG.threshold)
    return seen.groupBy(F.split_part(_of("file", "file"), F.lit("-"), F.lit(1)).alias("kind"), "convert_class", "view_class").agg(F.count("*").alias("n"), F.round(F.sum(F.when(~F.isnan("overall"), F.col("overall"))), 6).alias("total"), F.sum(F.length("text")).alias("chars"))


# curated sets, generation, comparison


def _curated(spark, sf_dir):
    return curation.curate(documents(spark, sf_dir, "doc_id", "text", "source", "lang"))


@query
def curate_ledger(spark, sf_dir):
    return _curated(spark, sf_dir).ledger


@query
def curate_kept(spark, sf_dir):
    return _curated(spark, sf_dir).kept.select("doc_id", F.md5("text").alias("text_md5"))


@query
def curate_card(spark, sf_dir):
    return curation.card(_curated(spark, sf_dir), ["source", "lang"])


@query
def generation_plan(spark, sf_dir):
    rows = generation.plan(documents(spark, sf_dir, "doc_id", "text"), generation.GenerationConfig())
    return rows.select("lineage", "generation", "parent", "seed", "paradigm", "model", F.md5("prompt").alias("prompt_md5"))


def _compared(spark, sf_dir):
    """Documents as what their source made of a seed, judged in the first round."""
    made = documents(spark, sf_dir, "doc_id", F.coalesce("source", F.lit("-")).alias("generator"), F.expr("doc_id div 20").alias("seed"))
    return judgments(spark, sf_dir, [1]).select("doc_id", F.col("model").alias("judge"), "score").join(made, "doc_id")


@query
def compare_matrix(spark, sf_dir):
    return comparison.matrix(_compared(spark, sf_dir))


@query
def compare_agreement(spark, sf_dir):
    return comparison.agreement(comparison.matrix(_compared(spark, sf_dir))).withColumn("correlation", F.round("correlation", 9))


@query
def compare_wins(spark, sf_dir):
    return comparison.wins(_compared(spark, sf_dir))


@query
def compare_strengths(spark, sf_dir):
    return comparison.strengths(comparison.wins(_compared(spark, sf_dir)))

"""Curated sets, generation, comparison and the commands on files, against brute force."""

import itertools
import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwright.config import EvalConfig
from siftwright.operators import comparison, curation
from siftwright.operators.judging import SyntheticJudge
from siftwright.plans import files, generation

LONG = "A text that says something, long enough."


def test_curation_by_hand(spark):
    texts = {1: LONG, 2: LONG.upper() + "!!", 3: "  a  text that says something   long enough ", 4: None, 5: "", 6: "short", 7: "12345 67890 12345 67890 abc", 8: LONG + " �", 9: "fill {{name}} into this sentence", 10: "Another text that stands for itself."}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = curation.curate(rows)
    ledger = {(r.doc_id, r.rule, r.of) for r in got.ledger.collect()}
    assert ledger == {(1, "duplicate", 3), (2, "duplicate", 3), (4, "blank", None), (4, "short", None), (5, "blank", None), (5, "short", None), (6, "short", None), (7, "letters", None), (8, "undecoded", None), (9, "template", None)}
    assert {r.doc_id for r in got.kept.collect()} == {3, 10} and got.kept.columns == ["doc_id", "text"]
    every = curation.curate(rows, keep_invalid=True)
    assert {r.doc_id for r in every.kept.collect()} == {3, 4, 5, 6, 7, 9, 10}  # 8 has the same form
    assert curation.curate(rows, rules=[]).kept.count() == 7
    assert curation.curate(rows.limit(0)).ledger.collect() == []


def test_a_form_that_fills_the_table(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, LONG).otherwise(F.concat(F.lit(LONG), F.col("id").cast("string"))).alias("text"))
    got = curation.curate(rows)
    assert got.kept.count() == 2001 and got.ledger.where("of = 0").count() == 999


def test_card(spark):
    rows = spark.createDataFrame([(1, LONG, "a", None), (2, LONG, "a", "x"), (3, "no", None, "x")], "doc_id long, text string, source string, lang string")
    got = curation.curate(rows)
    table = {(r.section, r.value): tuple(r)[2:] for r in curation.card(got, ["source", "lang"]).collect()}
    n = len(LONG)
    assert table == {("all", None): (3, 1, 1, 1, n), ("source", "a"): (2, 1, 0, 1, n), ("source", None): (1, 0, 1, 0, 0), ("lang", None): (1, 1, 0, 0, n), ("lang", "x"): (2, 0, 1, 1, 0)}
    text = curation.card_text(curation.card(got, []), got.ledger, "t")
    assert "| - | 3 | 1 | 1 | 1 |" in text and "| duplicate | 1 |" in text


class Echo:
    """Says the prompt's last line and its own count; fails for one model."""

    def __init__(self):
        self.asked = 0

    def answer(self, tasks):
        self.asked += tasks.count()
        bad = F.col("model") == "glm"
        return tasks.withColumn("raw", F.when(~bad, F.concat(F.lit("said "), F.element_at(F.split("prompt", "\n"), -1)))).withColumn("error", F.when(bad, "down"))


def test_generation_grows_and_resumes(spark, tmp_path):
    seeds = spark.createDataFrame([(1, "one"), (2, "two"), (3, " "), (4, None)], "doc_id long, text string")
    cfg = generation.GenerationConfig(generations=3, paradigms=("evol_instruct", "seed_rewrite"))
    assert generation.plan(seeds, cfg).count() == 2 * 2 * 3 * 3
    writer = Echo()
    rows = generation.grow(seeds, writer, cfg, str(tmp_path / "g")).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.lineage][r.generation] = r
    assert len(by) == 12 and all(len(v) == (1 if "glm" in k else 3) for k, v in by.items())
    assert by["1/evol_instruct/qwen/1"][3].raw == "said said said one" and writer.asked == 12 + 8 + 8
    again = Echo()
    assert generation.grow(seeds, again, cfg, str(tmp_path / "g")).count() == len(rows) and again.asked == 0
    more = Echo()
    generation.grow(seeds.union(spark.createDataFrame([(9, "nine")], seeds.schema)), more, cfg, str(tmp_path / "g"))
    assert more.asked == 6 + 4 + 4
    with pytest.raises(ValueError):
        generation.GenerationConfig(paradigms=("none",))


def test_strengths_by_brute_force(spark):
    rng = random.Random(5)
    true = {"a": 3.0, "b": 1.0, "c": 0.4, "d": 1.5}
    rows = [(seed, g, j, round(10 * true[g] / (true[g] + rng.random() * 2), 1) if rng.random() > 0.05 else None) for seed in range(60) for g in true for j in ("x", "y")] + [(0, "a", "x", 9.0)]
    scores = spark.createDataFrame(rows, "seed long, generator string, judge string, score double")
    won = comparison.wins(scores)
    means = defaultdict(list)
    for s, g, j, v in rows:
        if v is not None:
            means[s, j, g].append(v)
    want = defaultdict(lambda: [0, 0.0])
    for (s, j, g), (t, k, h) in itertools.product(means, means):
        if (s, j) == (t, k) and g < h:
            x, y = (sum(means[s, j, n]) / len(means[s, j, n]) for n in (g, h))
            want[g, h][0] += 1
            want[g, h][1] += 1.0 if x > y else 0.0 if x < y else 0.5
    assert {(r.a, r.b): [r.games, r.points] for r in won.collect()} == want
    got = {r.generator: r.strength for r in comparison.strengths(won).collect()}
    # at the maximum of the likelihood everyone's expected points are the points won
    for g in true:
        expected = sum(n * got[g] / (got[g] + got[b if a == g else a]) for (a, b), (n, _) in want.items() if g in (a, b))
        points = sum(p if a == g else n - p for (a, b), (n, p) in want.items() if g in (a, b))
        assert expected + got[g] / (got[g] + 1) == pytest.approx(points + 0.5, abs=1e-6)
    assert sorted(got, key=got.get) == sorted(true, key=true.get)
    assert comparison.strengths(won.limit(0)).collect() == []


def test_commands_on_files(spark, tmp_path, capsys):
    report = lambda score, text: {"meta": {"text": text}, "rounds": [{"round": 1, "dimensions": {"safety": {"m": {"score": 7.5}, "n": {"score": 6.0}}}}], "final": {"overall_score": score, "dimension_scores": {"safety": 6.75}}}
    rows = [report(7, "user: hi\nassistant: yo"), report(3, "low"), report("7", "bad"), report(6.5, "plain text")]
    (tmp_path / "r.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows[:2])))
    out = str(tmp_path / "out")
    files.main(["convert", "--input", str(tmp_path / "r.json"), "--output", out, "--format", "alpaca"])
    told = capsys.readouterr().out
    assert [int(x) for x in re.findall(r": (\d+)$", told, re.M)] == [4, 2, 1, 1, 1]
    assert [json.loads(r.value)["output"] for r in spark.read.text(out).collect()] == ["yo", ""] or [json.loads(r.value)["instruction"] for r in spark.read.text(out).collect()] == ["hi", "plain text"]
    files.main(["statistics", str(tmp_path / "r.json"), str(tmp_path / "s.jsonl")])
    told = capsys.readouterr().out
    assert "总语料数量: 6" in told and "合格（>= 5）: 3（50.0%）" in told and "分数缺失/异常: 1" in told
    got, told = files.evaluate_one(spark, SyntheticJudge(), EvalConfig(rounds=2), str(tmp_path / "e"), text="some text to judge")
    assert got.reports.count() == 1 and told.count("×") + told.count("未评分") >= 4 and "结论" in told
    (tmp_path / "c.jsonl").write_text(json.dumps({"doc_id": 1, "text": LONG}) + "\n" + json.dumps({"doc_id": 2, "text": LONG}))
    files.main(["curate", "--input", str(tmp_path / "c.jsonl"), "--output", str(tmp_path / "cur")])
    assert "| duplicate | 1 |" in capsys.readouterr().out and spark.read.json(str(tmp_path / "cur/curated")).count() == 1

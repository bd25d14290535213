import json
import math
import os
import random
import statistics
import threading
import time
import uuid
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright.config import EvalConfig
from siftwright.operators import evaluate, parse, reports, stats
from siftwright.operators.judging import HttpJudge, Pace, SyntheticJudge, post
from siftwright.plans import batch, evaluation
from siftwright.sources import corpus
from siftwright.sources import reports as files
from siftwright.streaming import scores as streaming

CFG = EvalConfig()

PARSES = [
    ("pre\nhuman: hi\nmore\nassistant: yo\nassistant: again", "conversation", [("human", "hi\nmore"), ("gpt", "yo\nagain")]),
    ("ai:\n\nhuman:x\ngpt:\n \nuser:y", "conversation", [("human", "x\ny")]),
    ("human:", "plain", None),
    ("instruction: a\nuser: q", "conversation", [("human", "q")]),
    ("用户:a\n助手：b", "conversation", [("human", "a"), ("gpt", "b")]),
    ("system: s\nuser: q", "conversation", [("human", "q")]),
    ("instruction: a\ninput:\noutput: b\ninput: c\nmore", "alpaca", ("a", "c\nmore", "b")),
    ("INPUT:", "alpaca", ("", "", "")),
    ("plain", "plain", None),
    ("", "plain", None),
]


def test_parse_and_convert(spark):
    df = parse.parse(spark.createDataFrame([(i, p[0]) for i, p in enumerate(PARSES)], "id int, text string"))
    for r in df.collect():
        _, kind, want = PARSES[r.id]
        assert r.type == kind
        if kind == "conversation":
            assert [(t.role, t.value) for t in r.turns] == want
        elif kind == "alpaca":
            assert (r.instruction, r.input, r.output) == want
    alpaca = {r.id: (r.instruction, r.input, r.output) for r in parse.to_alpaca(df).collect()}
    assert alpaca[0] == ("hi\nmore", "", "yo\nagain") and alpaca[8] == ("plain", "", "") and alpaca[6] == ("a", "c\nmore", "b")
    chat = {r.id: [(m["from"], m["value"]) for m in r.conversations] for r in parse.to_sharegpt(df).collect()}
    assert chat[6] == [("human", "a\nc\nmore"), ("gpt", "b")] and chat[7] == [] and chat[8] == [("gpt", "plain")]


def test_worked_example_and_null_dimensions(spark):
    rows = [(1, d, s) for d, s in zip(CFG.dimensions, (7.5, 8.0, 6.5, 7.0), strict=True)] + [(2, d, None) for d in CFG.dimensions] + [(3, "safety", 5.0), (3, "accuracy", None), (3, "diversity", 5.0), (3, "format", None)]
    got = {r.doc_id: r for r in evaluate.final_scores(spark.createDataFrame(rows, "doc_id int, dim string, score double"), CFG).collect()}
    assert got[1].overall_score == 7.38 and got[1].passed and got[1].conclusion == "合格"
    assert got[2].overall_score is None and not got[2].passed
    assert got[3].overall_score == 5.0 and got[3].passed


def test_trend(spark):
    df = spark.createDataFrame([([5.0, None, 7.0],), ([7.0, 5.0],), ([None, 6.0],), ([6.0, 6.0],), ([],)], "t array<double>")
    assert [r[0] for r in df.select(evaluate.arrow(F.col("t"))).collect()] == ["↑", "↓", "→", "→", "→"]


def _report(score, text='"user: q"', passed=""):
    return f'{{"meta": {{"text": {text}}}, "final": {{{passed}"overall_score": {score}}}}}'


CLASSES = [
    (_report("5"), "kept", "passed", True), (_report("5.0"), "kept", "passed", True), (_report("4.99"), "low", "failed", False), (_report("4.99", passed='"passed": true, '), "low", "failed", True),
    (_report("true"), "low", "invalid", False), (_report('"7"'), "skipped", "invalid", False), (_report("null"), "skipped", "invalid", False), ('{"meta": {"text": "x"}, "final": {}}', "skipped", "invalid", False),
    (_report("NaN"), "kept", "failed", False), ('{"meta": {"text": "x"}, "final": null}', "skipped", "invalid", False), ("[1, 2]", "skipped", "dropped", False), (_report("9", "3"), "skipped", "passed", True), (None, "skipped", "dropped", False),
]


def test_classes(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CLASSES)], "i int, report string")
    for r in reports.classify(rows, 5.0).collect():
        assert (r.convert_class, r.view_class, bool(r.web_passed)) == CLASSES[r.i][1:], CLASSES[r.i][0]


def test_readers(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name) or str(tmp_path / name)
    one, many = write("one.json", '{\n  "a": 1,\n  "final": {}\n}'), write("many.json", '[{"a": 1}, 3]')
    lines, bad, empty = write("l.jsonl", '\n{"a": 1}\n\n{"b": "x y"}\n'), write("bad.jsonl", '{"a": 1}\n{oops\n'), write("empty.json", "")
    n = lambda p, mode: len(files.read_reports(spark, p, mode).collect())
    assert (n(one, "strict"), n(many, "strict"), n(many, "objects"), n(lines, "strict")) == (1, 2, 1, 2)
    assert (n(bad, "lenient"), n(empty, "objects"), n(empty, "lenient")) == (1, 0, 0)
    for p in (bad, empty):
        with pytest.raises(Exception, match="not JSON|empty file"):
            n(p, "strict")
    got = files.preview(files.read_files(spark, [bad]), limit=2).collect()
    assert [(r.value, r.raw) for r in sorted(got, key=lambda r: r.pos)] == [('{"a": 1}', None), (None, "{oops")]


JSONS = [
    '{"a": 1}', '{"a": 1} trailing', "1 2", '"meta": {', '{"b": 2}{"c": 3}', "1, 2", "1], [2", "1] , [2", "NaN", '{"a": NaN}', "[Infinity, -Infinity]", "INF", '{"x": -INF}', "+Infinity", "{'a': 1}", '{"a":1,}', "01", "1.", ".5", "-",
    "null", "true", "tru", '"x"', '"x', '"a\\u00zz"', '"\\ud800"', '{"a":1,"a":2}', '1,"v":2', "", "{", "[", "[1,]", '[{"a": {"b": [1, {"c": NaN}]}}, 3, "s"]', '"tab\there"', '"\\x"', "1 // c", '{"a" 1}', '"INF"', '{"k": "a, INF, b"}', "1e400",
    "123456789012345678901234567890", "-0", "- 1", "nan", ' 1', '{"a":1} ', "1}", '{"a":1}}', '{"":1}', "0x1", '"a\nb"', "{1: 2}", '1 }, {"q": 1', '"a" "b"', "-NaN", '{"a":-Infinity}', "\xa01", '{"a": "\\"", "b": [{"c": "}"}]}',
]


def test_json_is_told_as_python_tells_it(spark):
    def loads(x):
        try:
            json.loads(x)
            return True
        except ValueError:
            return False

    got = spark.createDataFrame([(x,) for x in JSONS], "x string").select("x", files.valid(F.col("x")).alias("ok")).collect()
    assert [(r.x, r.ok) for r in got] == [(x, loads(x)) for x in JSONS]


def test_report_files_as_they_are_written(spark, tmp_path):
    report = {"meta": {"text": 'a "NaN" b\n{', "n": 1}, "rounds": [{"round": 1, "dimensions": {"safety": {"m": {"score": 7.5}}}}, {"round": 2, "dimensions": {}}], "final": {"overall_score": float("nan")}}
    indented = json.dumps(report, ensure_ascii=False, indent=2)
    (tmp_path / "one.json").write_text(indented, encoding="utf-8")
    (tmp_path / "many.json").write_text(json.dumps([report, 3, report], indent=2), encoding="utf-8")
    (tmp_path / "l.jsonl").write_text(json.dumps(report) + "\n" + '{"a": 1} x\n"meta": {\n{"b": 2}{"c": 3}\n' + json.dumps(report) + "\n", encoding="utf-8")
    for mode, one, many in (("strict", 1, 3), ("objects", 1, 2), ("lenient", 1, 3)):
        rows = files.read_reports(spark, str(tmp_path / "one.json"), mode).orderBy("ord").collect()
        assert len(rows) == one and repr(json.loads(rows[0].report)) == repr(report)
        rows = files.read_reports(spark, str(tmp_path / "many.json"), mode).orderBy("ord").collect()
        assert [repr(json.loads(r.report)) for r in rows] == [repr(x) for x in [report, 3, report] if many == 3 or x != 3]
    assert len(files.read_reports(spark, str(tmp_path / "l.jsonl"), "lenient").collect()) == 2
    with pytest.raises(Exception, match="not JSON"):
        files.read_reports(spark, str(tmp_path / "l.jsonl")).collect()
    kinds = reports.classify(files.read_reports(spark, str(tmp_path / "many.json"), "objects"), 5.0).collect()
    assert [(r.convert_class, r.view_class) for r in kinds] == [("kept", "failed")] * 2


def test_discovery_and_history(spark, tmp_path):
    for name in ("ui_eval_1.json", "eval_report_2.json", "eval_report_1.json", "_merged_reports.jsonl", "output_a.jsonl", "output_b.jsonl"):
        (tmp_path / name).write_text("{}")
    base = lambda found: [f.rsplit("/", 1)[1] for f in found]
    assert base(files.discover_reports(spark, str(tmp_path))) == ["_merged_reports.jsonl", "eval_report_1.json", "eval_report_2.json", "ui_eval_1.json"]
    assert base(files.artifacts(spark, str(tmp_path), 1)) == ["output_b.jsonl"] and base(files.convertible(spark, str(tmp_path)))[-1] == "ui_eval_1.json"
    assert files.discover_reports(spark, str(tmp_path / "none")) == []
    where = str(tmp_path / "history")
    corpus.append_history(spark.createDataFrame([("1", "p")], "id string, page string"), where)
    assert spark.read.json(where).count() == 1
    corpus.clear_history(spark, where)
    assert not (tmp_path / "history").exists()
    assert corpus.stamped("eval_report", now=datetime(2024, 1, 31, 23, 59, 58)) == "eval_report_20240131_235958.json"


def test_keys_from_a_file(tmp_path, monkeypatch):
    monkeypatch.setenv("KEY_A", "set")
    monkeypatch.delenv("KEY_B", raising=False)
    monkeypatch.delenv("KEY_C", raising=False)
    (tmp_path / ".env").write_text("# keys\nKEY_A=other\nexport KEY_B='b c'\nKEY_C=YOUR_KEY # todo\nnothing\n")
    judge = HttpJudge({m: ("http://x", m, f"KEY_{m}") for m in "ABC"}, env_file=str(tmp_path / ".env"))
    with pytest.warns(UserWarning, match="KEY_C"):
        assert judge.missing_keys() == ["KEY_C"]
    assert (os.environ["KEY_A"], os.environ["KEY_B"]) == ("set", "b c")
    for k in ("KEY_B", "KEY_C"):
        os.environ.pop(k)


def test_batch_command(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_text("\n".join(f"user: q{i} gpt: a" for i in range(1, 14)) + "\n\n", encoding="utf-8")
    batch.main(["--input", str(tmp_path / "c.txt"), "--output", str(tmp_path / "o"), "--format", "sharegpt", "--rounds", "1"])
    out = capsys.readouterr().out
    assert "共处理 13" in out and "安全性" in out and spark.read.text(str(tmp_path / "o/sharegpt")).count() > 0
    text = spark.read.text(str(tmp_path / "o/reports")).first().value
    assert '"error":null' not in text and json.loads(text)["meta"]["text"].startswith("user:")
    (tmp_path / "blank.txt").write_text("\n \n")
    with pytest.raises(ValueError, match="no items"):
        batch.main(["--input", str(tmp_path / "blank.txt"), "--output", str(tmp_path / "p"), "--format", "alpaca"])
    with pytest.raises(ValueError, match="no report"):
        evaluation.run(spark.createDataFrame([], "doc_id long, text string, n_chars long"), SyntheticJudge(), CFG, str(tmp_path / "q"))


def test_a_dimension_and_a_judge_more(spark):
    cfg = EvalConfig(dimensions=(*CFG.dimensions, "style"), models=(*CFG.models, ("own", "Own")))
    docs = spark.createDataFrame([(1, 5), (2, 9)], "doc_id long, n_chars long")
    rows = evaluate.judge_rows(SyntheticJudge().answer(evaluate.task_grid(docs, cfg)))
    assert rows.count() == 2 * 3 * 5 * 4
    finals = evaluate.final_scores(evaluate.dim_scores(rows.where("round = 3")), cfg)
    assert "style" in finals.columns and finals.count() == 2  # without a weight it counts 0


def test_rows_that_repeat_a_doc_id_ask_no_more_than_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "doc_id long, text string, n_chars long")
    assert evaluation.run_rounds(docs, SyntheticJudge(), EvalConfig(rounds=1), str(tmp_path / "r")).count() == 3 * 12


def test_corpus_sources(spark, tmp_path):
    (tmp_path / "c.txt").write_text("  a \n\n　\nb\x0bc\n", encoding="utf-8")
    rows = corpus.read_corpus(spark, str(tmp_path / "c.txt")).orderBy("item").collect()
    assert [(r.item, r.tag, r.line) for r in rows] == [(1, "0001", "a"), (2, "0002", "b"), (3, "0003", "c")]
    assert corpus.read_whole(spark, file=str(tmp_path / "c.txt"), text="no").first().text.startswith("a ")
    assert corpus.read_whole(spark, text=" x ").first().text == "x"
    with pytest.raises(ValueError):
        corpus.read_whole(spark, stdin=" ")
    with pytest.warns(UserWarning):
        assert corpus.expand_inputs([str(tmp_path / "*.txt"), str(tmp_path / "c.txt"), "/nowhere"]) == [str(tmp_path / "c.txt")]
    with pytest.raises(ValueError):
        corpus.check_prompts(spark.createDataFrame([("safety",)], "name string"), CFG.dimensions)


def test_model_table(spark):
    rows = [(1, 0, "d", "a", 4.0), (1, 0, "d", "b", 6.0), (2, 0, "d", "c", 5.0)]
    got = {r.model: r for r in stats.model_table(spark.createDataFrame(rows, "ord int, round_pos int, dim string, model string, score double")).collect()}
    assert got["a"].std == 0.0 and got["a"].mean_diff == 2.0 and got["c"].mean_diff is None


def test_model_table_is_pythons(spark):
    rng = random.Random(6)
    rows = [(o, r, d, m, m, rng.randrange(0, 1001) / 100) for o in range(40) for r in (0, 1) for d in ("safety", "format") for m in rng.sample(["a", "b", "c"], rng.randint(1, 3))]
    groups, scores, apart = {}, {}, {}
    for o, r, d, p, m, s in rows:
        groups.setdefault((o, r, d), []).append((m, s))
    for g in groups.values():
        for i, (m, s) in enumerate(g):
            scores.setdefault(m, []).append(s)
            others = [x for j, (_, x) in enumerate(g) if j != i]
            if others:
                apart.setdefault(m, []).append(abs(s - sum(others) / len(others)))
    df = spark.createDataFrame([(o, r, d, "abc".index(p), m, s) for o, r, d, p, m, s in rows], "ord int, round_pos int, dim string, model_pos int, model string, score double").repartition(5)
    for r in stats.model_table(df).collect():
        assert (r.n, r.std) == (len(scores[r.model]), statistics.stdev(scores[r.model]))
        assert r.mean == math.fsum(scores[r.model]) / r.n and r.mean_diff == math.fsum(apart[r.model]) / len(apart[r.model])


def test_run_asks_each_task_once_and_resumes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"user: q{i}\ngpt: a", 12) for i in range(1, 9)], "doc_id long, text string, n_chars long")
    cfg = EvalConfig(rounds=2)
    run = evaluation.run(docs, SyntheticJudge(), cfg, str(tmp_path / "r"))
    assert run.judgments.count() == 8 * 2 * 4 * 3 == run.judgments.select("doc_id", "round", "dim", "model").distinct().count()

    class Never:
        def answer(self, tasks):
            assert tasks.isEmpty()
            return SyntheticJudge().answer(tasks)

    assert evaluation.run_rounds(docs, Never(), cfg, str(tmp_path / "r/judgments")).count() == 8 * 2 * 4 * 3
    kept = run.finals.where("passed").count()
    assert run.records.count() == kept and spark.read.text(str(tmp_path / "r/alpaca")).count() == kept
    s = run.summary.first()
    assert s.total == 8 and s.passed == kept and s.passed + s.failed + s.invalid == 8


def test_http_judge_with_a_stub(spark):
    def transport(url, payload, headers, timeout):
        if "boom" in payload["messages"][-1]["content"]:
            raise RuntimeError("down")
        return {"choices": [{"message": {"content": " [[7]] "}}]}

    judge = HttpJudge({"m": ("http://x", "name", "STUB_KEY"), "n": ("http://x", "name", "NO_SUCH_KEY")}, partitions=2, transport=transport)
    tasks = spark.createDataFrame([(1, "m", None, "hi"), (2, "m", "s", "boom"), (3, "n", "s", "hi")], "doc_id int, model string, system_prompt string, prompt string")
    got = {r.doc_id: r for r in evaluate.judge_rows(judge.answer(tasks)).collect()}
    assert got[1].score == 7.0 and got[1].error is None
    assert (got[2].score, got[2].reason, got[2].error) == (None, "", "down") and "NO_SUCH_KEY" in got[3].error


def test_calls_are_concurrent_bounded_and_in_order():
    lock, now, most = threading.Lock(), [0], [0]

    def transport(url, payload, headers, timeout):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return {"choices": [{"message": {"content": payload["messages"][-1]["content"]}}]}

    judge = HttpJudge({"m": ("http://x", "name", "STUB_KEY")}, transport=transport, in_flight=3)
    tasks = pd.DataFrame({"model": "m", "system_prompt": None, "prompt": [f"p{i}" for i in range(20)]})
    got = pd.concat(judge.answers(iter([tasks[:12], tasks[12:]])))
    assert got.raw.tolist() == tasks.prompt.tolist() and 1 < most[0] <= 3


def test_pace():
    now, slept = [0.0], []
    pace = Pace(2.0, burst=3, clock=lambda: now[0], sleep=slept.append)
    for _ in range(4):
        pace.wait()
    assert slept == [0.5, 1.0, 1.5]  # nothing has been saved up yet
    now[0] += 100.0
    slept.clear()
    for _ in range(5):
        pace.wait()
    assert slept == [0.5, 1.0]  # a burst of three, then two a second
    Pace(None).wait()


class Counting:
    """Answers of the synthetic judge; each call leaves a file, and a document may kill its task."""

    def __init__(self, folder, kills=None, wait=0.0):
        self.folder, self.kills, self.wait = str(folder), kills, wait

    def answer(self, tasks):
        folder, kills, wait = self.folder, self.kills, self.wait

        def run(batches):
            for batch in batches:
                for t in batch.itertuples():
                    if t.doc_id == kills:
                        raise SystemError("the task is lost")
                    open(f"{folder}/{t.doc_id}-{t.round}-{t.dim}-{t.model}-{uuid.uuid4().hex}", "w").close()
                    time.sleep(wait)
                yield batch

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields)
        return SyntheticJudge().answer(tasks.mapInPandas(run, schema))


def test_a_killed_run_keeps_its_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluation, "TASKS", 24)
    (tmp_path / "calls").mkdir()
    docs = spark.createDataFrame([(i, f"t{i}", 3) for i in range(150)], "doc_id long, text string, n_chars long")
    cfg, where = EvalConfig(rounds=1), str(tmp_path / "r")
    with pytest.raises(Exception, match="the task is lost"):
        evaluation.run_rounds(docs, Counting(tmp_path / "calls", kills=77), cfg, where)
    while spark.sparkContext.statusTracker().getActiveStageIds():
        time.sleep(0.2)
    time.sleep(2)  # tasks that were killed have stopped calling
    kept = spark.read.parquet(f"{where}/round=1").count()
    made = len(os.listdir(tmp_path / "calls"))
    assert 0 < kept <= made < 1800
    got = evaluation.run_rounds(docs, Counting(tmp_path / "calls"), cfg, where)
    assert got.count() == 1800 == got.select("doc_id", "dim", "model").distinct().count()
    assert len(os.listdir(tmp_path / "calls")) == made + 1800 - kept  # what was kept is not asked again
    assert made - kept <= 24 * 2 * 4 * 3  # what is lost is no more than the tasks that ran
    again = evaluation.run_rounds(docs, Counting(tmp_path / "calls", kills=77), cfg, where)
    assert again.count() == 1800 and len(os.listdir(tmp_path / "calls")) == made + 1800 - kept


def test_partitions_and_batches_are_bounded():
    assert evaluation._batches(0, 8) == 1 and evaluation._batches(12 * 10**9, 8) == evaluation.MOST
    assert evaluation._batches(96 * 4 * 8 + 1, 8) == 2


def test_progress_while_a_round_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluation, "TASKS", 24)
    (tmp_path / "calls").mkdir()
    docs = spark.createDataFrame([(i, f"t{i}", 3) for i in range(60)], "doc_id long, text string, n_chars long")
    cfg, where, seen = EvalConfig(rounds=2), str(tmp_path / "r"), []
    work = threading.Thread(target=evaluation.run_rounds, args=(docs, Counting(tmp_path / "calls", wait=0.01), cfg, where))
    work.start()
    while work.is_alive():
        seen.append([r.answered for r in evaluation.progress(spark, where, 60, cfg).orderBy("round").collect()])
    rows = evaluation.progress(spark, where, 60, cfg).orderBy("round").collect()
    assert [tuple(r) for r in rows] == [(1, 720, 720, 100.0), (2, 720, 720, 100.0)]
    sums = [sum(x) for x in seen]
    assert sums == sorted(sums) and len(set(sums)) > 2


def test_post_retries():
    waits = []

    def fail(*a, **k):
        raise OSError("refused")

    with pytest.raises(RuntimeError, match="refused"):
        post("http://x", {}, {}, 1, sleep=waits.append, opener=fail)
    assert waits == [2.0, 4.0]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, 100 + i) for i in range(20)], "doc_id long, n_chars long").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, n_chars long").parquet(str(tmp_path / "in"))
    q = streaming.score_stream(docs, SyntheticJudge(), CFG, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_judging_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 2)], "doc_id long, n_chars long")
    plan = evaluate.final_scores(evaluate.dim_scores(evaluate.judge_rows(SyntheticJudge().answer(evaluate.task_grid(df, CFG)))), CFG)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastNestedLoopJoin" in plan


def test_report_keeps_nulls_and_order(spark):
    docs = spark.createDataFrame([(97, "t", 5)], "doc_id long, text string, n_chars long")
    j = evaluate.judge_rows(SyntheticJudge().answer(evaluate.task_grid(docs, CFG)))
    finals = evaluate.final_scores(evaluate.dim_scores(j.where("round = 3")), CFG)
    r = json.loads(reports.as_json(reports.nested(docs, j, finals, evaluate.round_trend(j, CFG), CFG)).first().report)
    assert r["final"]["overall_score"] is None and list(r["final"]["dimension_scores"]) == list(CFG.dimensions)
    assert [x["round"] for x in r["rounds"]] == [1, 2, 3] and list(r["rounds"][0]["dimensions"]["safety"]) == [m for _, m in CFG.models]

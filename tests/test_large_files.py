"""Files cut into many blocks: the same rows as from one string."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftwright.operators import reports as operators
from siftwright.sources import corpus, jsonstream, splits
from siftwright.sources import reports as files

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "\n\r", "\n\n"]


def tasks(spark, path, block, separator=None):
    return splits.rows_in_order(spark, path, separator, block).rdd.getNumPartitions()


@pytest.mark.parametrize("block", [5_000, 1 << 20])
@pytest.mark.parametrize("end", ["", "\n", "\r\n", "\x0b"])
def test_lines_of_every_break(spark, tmp_path, block, end):
    rng = random.Random(1)
    text = "".join(rng.choice(["", " ", "a", "日本", "b" * rng.randint(1, 90)]) + rng.choice(BREAKS) for _ in range(4000)) + "last" + end
    (tmp_path / "c.txt").write_bytes(text.encode())
    (tmp_path / "d.txt").write_bytes(b"one\n\ntwo")
    path = [str(tmp_path / "c.txt"), str(tmp_path / "d.txt")]
    assert block > 1 << 19 or tasks(spark, path, block) > 10
    want = [(i, x.strip()) for i, x in enumerate(text.splitlines()) if x.strip()]
    got = splits.lines(spark, path, block=block).where(F.col("file").endswith("c.txt")).orderBy("pos").collect()
    assert [(r.pos, r.line) for r in got] == want
    rows = splits.items(spark, path, block).orderBy("file", "item").collect()
    assert [(r.item, r.line) for r in rows if r.file.endswith("c.txt")] == [(i + 1, x) for i, (_, x) in enumerate(want)]
    assert [(r.item, r.line) for r in rows if r.file.endswith("d.txt")] == [(1, "one"), (2, "two")]
    first = corpus.read_corpus(spark, path[0], block).orderBy("item").first()
    assert first.tag == "0001" and first.line == want[0][1]


def test_line_feeds_only(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes("a b\r\n\nc\rd\n".encode())
    got = splits.lines(spark, str(tmp_path / "c.txt"), feeds_only=True).orderBy("pos").collect()
    assert [(r.pos, r.line) for r in got] == [(0, "a b"), (2, "c\rd")]


def test_places_do_not_depend_on_the_sessions_settings(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\n".join(f"line {i}" for i in range(20_000)))
    rows = splits.items(spark, str(tmp_path / "c.txt"), 10_000)
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3333")
        assert all(r.line == f"line {r.item - 1}" for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def odd_reports(n, seed=2):
    rng = random.Random(seed)
    marks = ['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "日", " ", "a", " "]
    word = lambda k: "".join(rng.choice(marks) for _ in range(rng.randint(0, k)))
    for i in range(n):
        yield rng.choice([{"i": i, "t": word(80), "deep": [[{"x": [word(5)]}, []], {}]}, [1, [word(9)]], word(30), i, None, True, 1.5, {}, []])


@pytest.mark.parametrize(("block", "indent", "end"), [(900, None, ""), (900, 2, "\n"), (1 << 20, None, " \n\n")])
def test_arrays_across_blocks(spark, tmp_path, monkeypatch, block, indent, end):
    if end:
        monkeypatch.setattr(jsonstream, "MOST_BROADCAST", 0)  # blocks' states are joined
        monkeypatch.setattr(jsonstream, "SLICE", 100)
    want = {"a.json": list(odd_reports(120)), "b.json": [], "c.json": [{"only": "one}"}], "d.json": ["}"], "l.jsonl": [{"x": "a} "}, [1, 2], {"y": 2}]}
    for name, rows in want.items():
        text = "\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) if name.endswith("l") else json.dumps(rows, indent=indent, ensure_ascii=False)
        (tmp_path / name).write_bytes((("  " if indent else "") + text + end).encode())
    big = {"t": ["}" * 9, {"deep": 'quo"te\\'}] * 200}
    (tmp_path / "o.json").write_text(json.dumps(big, indent=indent) + end)
    want["o.json"] = [big]
    assert block > 1 << 19 or tasks(spark, str(tmp_path), block, "}") > 8
    got = {}
    for r in sorted(files.read_reports(spark, str(tmp_path / "*"), block=block).collect(), key=lambda r: r.ord):
        got.setdefault(r.file.rpartition("/")[2], []).append(json.loads(r.report))
    assert got == {k: v for k, v in want.items() if v}


def put(tmp_path, **named):
    for name, text in named.items():
        (tmp_path / name.replace("__", ".")).write_text(text)
    return str(tmp_path / "*")


BROKEN = ["[1, 2", "[1 2]", "[1,,2]", "[1,]", '{"a": 1', '{"a": 1} x', "[1] x", '[1] "]', "[1}]", "nonsense", '{"a": "}', "[1]]"]


def test_broken_files(spark, tmp_path):
    path = put(tmp_path, good__json="[1, 2]", lines__jsonl='{"a": 1}\nbad\n[2]\n', **{f"bad{i}__json": t for i, t in enumerate(BROKEN)})
    assert sorted((r.file.rpartition("/")[2], r.report) for r in files.read_reports(spark, path, "lenient", block=4).collect()) == [("good.json", "1"), ("good.json", "2"), ("lines.jsonl", "[2]"), ("lines.jsonl", '{"a": 1}')]
    for i in (0, 2, 4, 6):
        with pytest.raises(Exception, match="not JSON"):
            files.read_reports(spark, str(tmp_path / f"bad{i}.json")).collect()


def test_several_values_are_lines(spark, tmp_path):
    path = put(tmp_path, a__json='[1]\n5\n', b__json='{"a": 1}\n{"b": 2}\n', c__json='7\n"x"')
    got = sorted((r.file[-6:], r.ord, r.report) for r in files.read_reports(spark, path, block=3).collect())
    assert got == [("a.json", 0, "[1]"), ("a.json", 1, "5"), ("b.json", 0, '{"a": 1}'), ("b.json", 1, '{"b": 2}'), ("c.json", 0, "7"), ("c.json", 1, '"x"')]
    assert [r.report for r in files.read_reports(spark, path, "objects").orderBy("ord").collect()] == ['{"a": 1}', '{"b": 2}']
    with pytest.raises(ValueError, match="empty"):
        files.read_reports(spark, put(tmp_path, e__json=" \n"))


def test_a_report_is_parsed_once_to_be_checked(spark, tmp_path):
    path = put(tmp_path, a__json='[{"a": 1}, [2]]', l__jsonl='{"b": 1}\n \n3\n', bad__jsonl='{"c": 1}\n{"c"\n')
    for mode in ("objects", "lenient"):
        plan = files.read_reports(spark, path, mode)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        parsed = [(line.strip("+-: ").split()[0], line.count("from_json(")) for line in plan if "from_json(" in line]
        # a projection works out what it names twice once, a filter does not
        assert parsed and all(name == "Project" and n <= 2 for name, n in parsed)
    good = files.read_reports(spark, [str(tmp_path / "a.json"), str(tmp_path / "l.jsonl")], "objects")
    assert sorted((r.file[-1], r.ord, r.report) for r in good.collect()) == [("l", 0, '{"b": 1}'), ("n", 0, '{"a": 1}')]
    with pytest.raises(Exception, match="not JSON"):  # counted or read
        files.read_reports(spark, path, "objects").count()


def test_a_report_of_25_megabytes(spark, tmp_path):
    """A text longer than the parser's usual bound, and a number of 2,000 digits."""
    text = ("x" * 4999 + "}") * 5_200
    (tmp_path / "a.json").write_text(f'[{{"meta": {{"text": "{text}"}}, "final": {{"overall_score": 7}}}}, {{"meta": {{"text": "short"}}, "n": {"1" * 2000}, "final": {{"overall_score": 2}}}}]')
    got = operators.classify(files.read_reports(spark, str(tmp_path / "a.json"), block=1 << 20), 5.0).select("ord", "convert_class", F.length("text").alias("n")).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, "kept", len(text)), (1, "low", 5)]


def test_a_head_reads_no_more_than_it_shows(spark, tmp_path):
    line = json.dumps({"t": "y" * 200})
    for name, n in (("small.jsonl", 1_000), ("large.jsonl", 200_000)):
        (tmp_path / name).write_text("\n".join(["", "not json"] + [line] * n))
    read = {}
    for name in ("small.jsonl", "large.jsonl"):
        rows = files.preview_files(spark, [str(tmp_path / name)], limit=20)
        got = rows.collect()
        assert [(r.pos, r.value is None) for r in got] == [(1, True)] + [(i, False) for i in range(2, 20)]
        context = spark.sparkContext
        none = context._gateway.new_array(context._jvm.double, 0)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        read[name] = stages.apply(0).inputBytes()  # the latest stage's; it tells nothing of less than a thousand rows
    assert read["large.jsonl"] < 1_000_000 < (tmp_path / "large.jsonl").stat().st_size
    assert rows.rdd.getNumPartitions() == 1

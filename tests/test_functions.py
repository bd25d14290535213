import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from siftwright.functions import exact, pytext, score

SCORES = [("分数：[[8]]", 8.0), ("[[8.5]] later [[2]]", 8.5), ("[[15]]", 10.0), ("[[-3]]", 3.0), ("[[ 8 ]]", 8.0), ("[[8.]]", 8.0), ("8/10", 10.0), ("得分 7.5 分", 7.5), ("2024年", None), ("12.5", None), ("无", None), ("1.2.3", 3.0), ("[[rating]] 9", 9.0), ("[[８]]", 8.0), ("", None)]


def test_scores(spark):
    df = spark.createDataFrame(SCORES, "raw string, want double")
    assert df.where(~score.extract_score(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0


def test_reason(spark):
    cases = [("精炼理由：好。\n完整分析：x 分数：[[8]]", "好"), ("精炼理由:  a \n b[[3]]", "a b"), ("精炼理由：。[[3]]", "精炼理由：。"), ("text before [[4]] after", "text before"), ("x" * 120, "x" * 100 + "…"), ("", "")]
    df = spark.createDataFrame(cases, "raw string, want string").withColumn("got", score.extract_reason(F.col("raw")))
    assert [(r.raw, r.got) for r in df.collect()] == cases


def python_reason(raw, most=100):
    """The same by one regular expression with Python's white space."""
    short = lambda x: x[:most] + "…" if len(x) > most else x
    m = re.search(r"精炼理由[:：]\s*(.+?)(?=完整分析|分数[:：]|\[\[|\Z)", raw, re.S)
    named = re.sub(r"\s+", " ", m[1]).strip(" 。.；;，,") if m else ""
    tag = re.search(r"\[\[(\d+(?:\.\d+)?)\]\]", raw, re.A)
    return short(named) if named else short(re.sub(r"\s+", " ", raw[: tag.start()] if tag else raw).strip())


def test_reasons_by_a_regular_expression(spark):
    rng = random.Random(8)
    parts = ["精炼理由", ":", "：", " ", "\n", "。", "；", "a", "好😀", "完整分析", "分数", "[[", "[[7]]", "x" * 40, "理由"]
    raws = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    raws += ["精炼理由：" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    got = spark.createDataFrame([(x,) for x in raws], "raw string").select("raw", score.extract_reason(F.col("raw")).alias("got")).collect()
    assert [(r.raw, r.got, python_reason(r.raw)) for r in got if r.got != python_reason(r.raw)] == []


def test_moments_are_exact(spark):
    rng = random.Random(3)
    kinds = {"quarters": lambda: rng.randrange(41) / 4, "cents": lambda: rng.randrange(1001) / 100, "any": lambda: rng.uniform(-20, 1e6), "near": lambda: 7 + rng.random() * 1e-9, "same": lambda: 0.1, "small": lambda: rng.random() * 1e-9}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(500)] + [("one", 7.3)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7).withColumn("l", exact.limbs(F.col("x")))
    told = df.groupBy("k").agg(*exact.sums("l")).select("k", exact.mean("l_n", "l_s").alias("mean"), exact.deviation("l_n", "l_s", "l_p").alias("std"))
    for r in told.collect():
        xs = [x for k, x in rows if k == r.k]
        assert r.mean == math.fsum(xs) / len(xs) and r.std == (statistics.stdev(xs) if len(xs) > 1 else 0.0), r.k


def test_round_half_even_on_the_binary_value(spark):
    rng = random.Random(1)
    xs = [2.675, 0.125, 1.005, 8.165, 5.335, 0.0, 10.0, 1.365, 0.005, 0.004999999999999999, 0.015, 1e-9, 5e-324, 16.0, 99.995, 100.125, 1e6 + 0.125, 2.0**51 + 0.5, 2.0**52 + 1, 2.0**53, 1e15 + 0.125, 1e17, 1e300, 123456789012.345, 9007199254740.993]
    xs += [rng.randrange(0, 1_000_000) / 100_000 for _ in range(2000)] + [a / b for a in range(1, 60) for b in (2, 3, 6, 8)] + [rng.uniform(0, 10 ** rng.randrange(1, 16)) for _ in range(2000)] + [rng.randrange(1, 10**7) / 1000 for _ in range(1000)]
    xs += [-x for x in xs]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("got", pytext.round2(F.col("x")))
    assert [(r.x, r.got, round(r.x, 2)) for r in df.collect() if r.got != round(r.x, 2)] == []
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(pytext.round2(F.col("x")).alias("r")).collect()
    assert odd[0].r != odd[0].r and odd[1].r == float("inf") and odd[2].r is None


@pytest.mark.parametrize("text", ["", "a", "　a b\xa0\x1c", " \n\t ", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i\n", "\n", "a\n\n", "​x"])
def test_strip_and_splitlines(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(pytext.strip(F.col("t")).alias("s"), pytext.splitlines(F.col("t")).alias("l")).first()
    assert (r.s, r.l) == (text.strip(), text.splitlines())


def test_blank_and_strip_of_every_white_space(spark):
    white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [*white, "".join(white), *[w + "é" for w in white], *["😀" + w for w in white], *[f"{w}a{w}b{w}" for w in white], "", "\x00", "\u200b", "\ufeff ", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pytext.strip(F.col("t")).alias("s"), pytext.blank(F.col("t")).alias("b")).collect()
    assert [(r.s, r.b) for r in got] == [(t and t.strip(), None if t is None else not t.strip()) for t in texts]


def test_bucket_and_bar(spark):
    df = spark.createDataFrame([(3.99,), (4.0,), (6.99,), (7.0,), (None,), (float("nan"),), (2.5,), (11.0,)], "x double")
    got = df.select(score.bucket(F.col("x")).alias("b"), score.bar(F.col("x")).alias("bar")).collect()
    assert [r.b for r in got] == [0, 1, 1, 2, None, 2, 0, 2]
    assert got[4].bar == "·" * 10 and got[6].bar == "██········" and got[7].bar == "█" * 10

"""What a judge's answer says: score, short reason, bucket, bar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import SPACE, ascii_digits, collapse, once, strip

# fixed values: score tag, loose number, marks that begin and end the short reason, and the characters stripped from it
TAG = r"\[\[(\d+(?:\.\d+)?)\]\]"
NUMBER = r"(\d+(?:\.\d+)?)"
REASON_MARKS = ("精炼理由:", "精炼理由：")
REASON_ENDS = ("完整分析", "分数:", "分数：", "[[")
REASON_TRIM = " 。.；;，,"


def extract_score(raw: Column) -> Column:
    """First [[number]], at most 10; else the last number from 0 to 10; else null."""
    raw = ascii_digits(raw)
    loose = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(NUMBER), 1), lambda x: x.cast("double")), lambda x: x.between(0, 10))
    tagged = F.least(F.lit(10.0), F.regexp_extract(raw, TAG, 1).try_cast("double"))
    return F.when(raw.rlike(TAG), tagged).otherwise(F.try_element_at(loose, F.lit(-1)))


def _short(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def _named(raw: Column) -> Column:
    """What follows the first mark of a short reason, from its first character that is no white space up to an end mark after it; null without a mark."""

    def up_to_end(body: Column) -> Column:
        rest = F.substring(body, F.lit(2), F.length(body))  # an end mark that comes at once ends nothing
        ends = F.array_min(F.filter(F.array(*[F.instr(rest, F.lit(e)) for e in REASON_ENDS]), lambda at: at > 0))
        return F.concat(F.left(body, F.lit(1)), once(ends, lambda at: F.when(at.isNull(), rest).otherwise(F.left(rest, at - 1))))

    at = F.array_min(F.filter(F.array(*[F.instr(raw, F.lit(m)) for m in REASON_MARKS]), lambda x: x > 0))
    after = once(at, lambda x: F.substring(raw, x + len(REASON_MARKS[0]), F.length(raw)))
    return once(F.regexp_replace(after, rf"\A{SPACE}+", ""), up_to_end)


def extract_reason(raw: Column, most: int = 100) -> Column:
    """The short reason of an answer, else what stands before its score tag."""
    tidy = lambda x: F.btrim(collapse(x), F.lit(REASON_TRIM))
    before = once(strip(collapse(F.get(F.split(raw, TAG, 2), F.lit(0)))), lambda x: _short(x, most))
    return once(tidy(_named(raw)), lambda named: F.when(named != "", _short(named, most)).otherwise(before))


def bucket(score: Column) -> Column:
    """0 below 4, 1 below 7, else 2 (NaN too); null for null."""
    return F.when(score.isNull(), None).when(score < 4, 0).when((score < 7), 1).otherwise(2)


def bar(score: Column, width: int = 10) -> Column:
    """One full block a point, half to even; null has none."""
    n = F.bround(F.least(F.lit(10.0), F.greatest(F.lit(0.0), score)), 0).cast("int")
    full = F.when(score.isNull(), 0).otherwise(n)
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("·"), F.lit(width) - full))

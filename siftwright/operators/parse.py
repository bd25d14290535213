"""Recognising dialogue and instruction texts: row-local array functions, no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import SPACE, splitlines, strip

# fixed values: line markers and what they stand for
ROLES = {"human": "human", "user": "human", "人": "human", "用户": "human", "gpt": "gpt", "assistant": "gpt", "ai": "gpt", "助手": "gpt"}
FIELDS = {"instruction": "instruction", "input": "input", "output": "output", "指令": "instruction", "输入": "input", "输出": "output"}


def _marker(words: dict[str, str]) -> str:
    longest_first = sorted(words, key=len, reverse=True)
    return rf"(?iu)\A{SPACE}*({'|'.join(longest_first)}){SPACE}*[:：]{SPACE}*(.*)\z"


def _lookup(words: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.try_element_at(table, key)


def _filled(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x != "")


def segments(texts: DataFrame, lines: str, words: dict[str, str], out: str) -> DataFrame:
    """Adds ``out``: array<struct<kind, value>>, a marker's own content and the lines up to the next marker.

    Lines before the first marker are dropped.  Letters that fold to a marker
    only in Unicode (the long s, the dotless i) match but name nothing, and
    such a line is skipped.  Every step is a column of its own, so that none is
    evaluated anew for each element of the next.
    """
    mark = _marker(words)
    key, kind, at = f"{out}_key", f"{out}_kind", f"{out}_at"
    df = texts.withColumn(key, F.transform(lines, lambda x: F.lower(F.regexp_extract(x, mark, 1))))
    df = df.withColumn(kind, F.transform(key, lambda k: F.when(k == "", "").otherwise(_lookup(words, k))))
    df = df.withColumn(at, F.filter(F.transform(kind, lambda k, i: F.when(k != "", i)), lambda i: i.isNotNull()))
    # lines that belong to a segment, the markers' own content in place of the markers, null for what is left out
    own = lambda x: strip(F.regexp_extract(x, mark, 2))
    body = F.transform(lines, lambda x, i: F.when(F.get(F.col(kind), i) == "", x).when(F.get(F.col(kind), i).isNotNull(), F.nullif(own(x), F.lit(""))))
    df = df.withColumn(f"{out}_body", body)

    def one(p: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col(at), k + 1), F.size(f"{out}_body"))
        return F.struct(F.get(F.col(kind), p).alias("kind"), strip(F.array_join(F.slice(f"{out}_body", p + 1, end - p), "\n")).alias("value"))

    return df.withColumn(out, F.transform(at, one)).drop(key, kind, at, f"{out}_body")


def _joined(df: DataFrame, segs: str, out: str) -> DataFrame:
    """Adds ``out``: array<struct<role, value>>, neighbours of one role joined."""
    s, at = F.col(segs), f"{out}_at"
    starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["kind"] != F.get(s, i - 1)["kind"]), i)), lambda i: i.isNotNull())

    def one(p: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col(at), k + 1), F.size(s))
        return F.struct(F.get(s, p)["kind"].alias("role"), F.array_join(F.transform(F.slice(s, p + 1, end - p), lambda x: x["value"]), "\n").alias("value"))

    return df.withColumn(at, starts).withColumn(out, F.transform(at, one)).drop(at)


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def parse(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds type (conversation, alpaca or plain), turns, instruction, input, output and plain; what does not apply is null.

    A dialogue goes before an instruction text.  Empty turns are dropped before
    neighbours of one role are joined.  A field given twice keeps the later
    value; fields not given are empty.
    """
    out = texts.withColumn("__lines", splitlines(F.col(text)))
    out = segments(out, "__lines", ROLES, "__said")
    out = out.withColumn("__said", F.filter("__said", lambda x: x["value"] != ""))
    out = segments(_joined(out, "__said", "__turns"), "__lines", FIELDS, "__fields")
    talk, asked = F.size("__turns") > 0, (F.size("__turns") <= 0) & (F.size("__fields") > 0)
    own = lambda f: F.try_element_at(F.filter("__fields", _of_kind(f)), F.lit(-1))["value"]
    parsed = F.struct(
        F.when(talk, "conversation").when(asked, "alpaca").otherwise("plain").alias("type"),
        F.when(talk, F.col("__turns")).alias("turns"),
        *[F.when(asked, F.coalesce(own(f), F.lit(""))).alias(f) for f in ("instruction", "input", "output")],
        F.when(~talk & ~asked, strip(F.col(text))).alias("plain"),
    )
    # filters on the result must not be pushed below: there they would repeat every step for every use
    return out.select(*texts.columns, F.explode(F.array(parsed)).alias("__parsed")).select(*texts.columns, "__parsed.*")


def to_alpaca(parsed: DataFrame) -> DataFrame:
    """instruction, input and output of every parsed text."""
    values = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["value"])
    human, gpt = values("human"), values("gpt")
    pick = lambda talk, own, plain: F.when(F.col("type") == "conversation", talk).when(F.col("type") == "alpaca", F.col(own)).otherwise(plain)
    rest = F.array_join(F.slice(human, 2, F.greatest(F.lit(0), F.size(human) - 1)), "\n")
    return parsed.select(
        *[c for c in parsed.columns if c not in ("turns", "plain", "instruction", "input", "output")],
        pick(F.coalesce(F.get(human, F.lit(0)), F.lit("")), "instruction", F.col("plain")).alias("instruction"),
        pick(rest, "input", F.lit("")).alias("input"),
        pick(F.array_join(gpt, "\n"), "output", F.lit("")).alias("output"),
    )


def to_sharegpt(parsed: DataFrame) -> DataFrame:
    """conversations: array<struct<from, value>> of every parsed text."""
    said = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    talk = F.transform("turns", lambda t: F.struct(t["role"].alias("from"), t["value"].alias("value")))
    asked = F.array_join(_filled(F.col("instruction"), F.col("input")), "\n")
    alpaca = F.filter(F.array(said("human", asked), said("gpt", F.col("output"))), lambda m: m["value"] != "")
    plain = F.array(said("gpt", F.col("plain")))
    out = F.when(F.col("type") == "conversation", talk).when(F.col("type") == "alpaca", alpaca).otherwise(plain)
    return parsed.select(*[c for c in parsed.columns if c not in ("turns", "plain", "instruction", "input", "output")], out.alias("conversations"))

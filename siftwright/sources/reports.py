"""Report files: strict and lenient readers, writers, previews.

Dirty reports stay JSON strings until a typed question is asked, so a boolean,
a numeric string, NaN and a missing key remain different things.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import blank, strip
from ..storage import file_system
from . import jsonstream, splits
from .jsonstream import SPACES

OBJECT = "map<string,variant>"
ROUNDS = "struct<rounds:array<variant>>"
#: the parser's bounds on strings, numbers and nesting, lifted to what a row can hold
NO_LIMITS = {"maxStringLen": str((1 << 31) - 1), "maxNumLen": str((1 << 31) - 1), "maxNestingDepth": "100000"}


# a JSON string, and the words that Python reads as numbers
STRING = r'"(?:[^"\\]|\\.)*+"'
WORDS = r"-?Infinity|NaN"


def valid(j: Column) -> Column:
    """Whether json.loads takes the whole text: no more, no less.

    The text is set between two keys.  The second, a hash of the text, is met
    only if the text is one value and nothing else.
    """
    last = F.md5(j)
    whole = F.from_json(F.concat(F.lit('{"v":'), j, F.lit(',"'), last, F.lit('":0}')), "map<string,string>", NO_LIMITS | {"allowSingleQuotes": "false"})
    one = (F.size(whole) == 2) & F.map_contains_key(whole, last)
    odd = F.when(j.contains("INF") | j.contains("+I"), F.regexp_replace(j, STRING, "").rlike(r"INF|\+I")).otherwise(False)
    return F.coalesce(one & ~odd, F.lit(False))


def is_object(j: Column) -> Column:
    return valid(j) & F.ltrim(j, F.lit(SPACES)).startswith("{")


def _checked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ok``, whether report is valid: worked out once, as no filter on it moves below a one-row explode."""
    keep = [c for c in rows.columns if c != "report"]
    one = rows.select(*keep, F.explode(F.array("report")).alias("report")).withColumn("ok", valid(F.col("report")))
    return one.select(*keep, F.explode(F.array(F.struct("report", "ok"))).alias("x_")).select(*keep, "x_.report", "x_.ok")


def members(array: Column) -> Column:
    """JSON strings of an array's members; NaN and infinities stay bare words, as Python writes them."""
    mark = F.md5(array)
    pieces = F.regexp_extract_all(array, F.lit(rf'{STRING}|[^"]+'), 0)
    quoted = F.array_join(F.transform(pieces, lambda x: F.when(x.startswith('"'), x).otherwise(F.regexp_replace(x, F.lit(f"({WORDS})"), F.concat(F.lit('"'), mark, F.lit('$1"'))))), "")
    words = array.contains("NaN") | array.contains("Infinity")
    source = F.when(words, quoted).otherwise(array)
    # as text, objects keep the order of their keys and may repeat one; variants tell strings from what only looks like something else
    text, typed = F.from_json(source, "array<string>", NO_LIMITS), F.transform(F.from_json(source, "array<variant>", NO_LIMITS), lambda x: F.to_json(x))
    got = F.coalesce(F.zip_with(text, typed, lambda x, v: F.when(v.rlike(r"^[\[{]"), x).otherwise(v)), text)
    bare = F.transform(got, lambda x: F.regexp_replace(x, F.concat(F.lit('"'), mark, F.lit(f'({WORDS})"')), F.lit("$1")))
    return F.when(words, bare).otherwise(got)


def explode_files(files: DataFrame, strict: bool = True, objects: bool = False) -> DataFrame:
    """files (file, content): one object, an array, or JSON lines; gives file, ord, report (a JSON string).

    Strict: a file that is no object or array as a whole is read by lines, and
    one that is not JSON fails the query.  Lenient: files named ``.jsonl`` are
    read by lines, others as a whole, and what is not JSON is left out.
    ``objects`` keeps objects only.  Lines end at line feeds alone, so
    separators inside strings do no harm.
    """
    c = F.col("content")
    body = F.ltrim(c, F.lit(SPACES))
    parts = F.when(body.startswith("["), members(c)).when(body.startswith("{"), F.array(strip(c)))
    whole = F.when(valid(c), parts)
    lines = F.filter(F.transform(F.split("content", "\n"), strip), lambda x: x != "")
    if strict:
        items = F.coalesce(whole, lines)
    else:
        items = F.when(F.col("file").endswith(".jsonl"), lines).otherwise(whole)
    out = files.select("file", F.posexplode(items).alias("ord", "report"))
    ok = valid(F.col("report"))
    if strict:
        out = out.withColumn("report", F.when(ok, F.col("report")).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.col("file"), F.lit(" item "), F.col("ord")))))
    else:
        out = out.where(ok)
    return out.where(is_object(F.col("report"))) if objects else out


def read_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Whole small files, for explode_files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def _has_empty(spark: SparkSession, path: str) -> bool:
    """Whether a file of this path or glob has no bytes; Spark's readers leave such files out."""
    where, system = file_system(spark, path)
    found = system.globStatus(where) or []
    return any(f.isFile() and f.getLen() == 0 for f in found)


def read_reports(spark: SparkSession, paths: list[str] | str, mode: str = "strict", block: int | None = None) -> DataFrame:
    """(file, ord, report) of report files of any size, as explode_files tells of small ones.

    mode strict: any JSON value, bad lines and empty files fail; objects:
    objects only, bad lines fail; lenient: bad lines, and files that are no
    JSON as a whole and not named ``.jsonl`` (as their folder may be, too), are
    left out.  Large files are
    read by many tasks, arrays too; a report has to fit in a row.
    """
    strict = mode != "lenient"
    if mode == "strict":
        for path in [paths] if isinstance(paths, str) else paths:
            if _has_empty(spark, path):
                raise ValueError(f"empty file: {path}")
    parts, kinds = jsonstream.members(spark, paths, block)
    if mode == "strict":
        empty = kinds.where("blank").first()
        if empty:
            raise ValueError(f"empty file: {empty.file}")
    parts = parts.select("file", "ord", F.col("text").alias("report"))
    named = F.col("file").rlike(r"\.jsonl(/[^/]*)?$")
    # lines are stripped when they are numbered, of these files alone: the others may be large
    by_line = splits.rows_in_order(spark, paths, "\n", block).select("file", "block", "value").where(~blank(F.col("value")))
    by_line = by_line.where(named) if not strict else by_line.join(kinds.where("kind = 'lines'").select("file"), "file", "left_semi")
    by_line = splits.numbered(by_line, "ord").select("file", "ord", strip(F.col("value")).alias("report"))
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.col("file"), F.lit(" item "), F.col("ord")))
    if mode == "strict":
        return parts.unionByName(by_line).withColumn("report", F.when(valid(F.col("report")), F.col("report")).otherwise(bad))
    if mode == "objects":
        opens = F.ltrim(F.col("report"), F.lit(SPACES)).startswith("{")
        return _checked(parts.unionByName(by_line)).where(F.when(F.col("ok"), opens).otherwise(bad.cast("boolean"))).drop("ok")
    parts = _checked(parts.where(~named))
    parts = parts.join(parts.where("not ok").select("file").distinct(), "file", "left_anti")
    return parts.drop("ok").unionByName(_checked(by_line).where("ok").drop("ok"))


def preview_files(spark: SparkSession, files: list[str], limit: int = 100) -> DataFrame:
    """preview() of files of any size: no more is read of each than its first lines."""
    return _previewed(splits.heads(spark, files, limit))


def _previewed(lines: DataFrame) -> DataFrame:
    lines = lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
    ok = valid(F.col("line"))
    return lines.select("file", "pos", F.when(ok, F.col("line")).alias("value"), F.when(~ok, F.col("line")).alias("raw"))


def preview(files: DataFrame, limit: int = 100) -> DataFrame:
    """file, pos, value, raw: the first ``limit`` physical lines; blank ones are left out but counted, a bad line stays as raw."""
    return _previewed(files.select("file", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where(F.col("pos") < limit))


def discover_reports(spark: SparkSession, folder: str) -> list[str]:
    """Report files of a folder on any store: the merged ones first, then single evaluations, then those of the user interface, each by name."""
    return [f for pattern in ("_merged_reports.jsonl", "eval_report_*.json", "ui_eval_*.json") for f in _listed(spark, f"{folder}/{pattern}")]


def convertible(spark: SparkSession, folder: str) -> list[str]:
    """Everything that can be converted: JSON lines first, then JSON files, by name."""
    return [f for pattern in ("*.jsonl", "*.json") for f in _listed(spark, f"{folder}/{pattern}")]


def artifacts(spark: SparkSession, folder: str, n: int = 5) -> list[str]:
    """The last ``n`` converted outputs in reverse order of their names."""
    return _listed(spark, f"{folder}/output_*.jsonl")[::-1][:n]


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    where, system = file_system(spark, pattern)
    found = system.globStatus(where) or []
    return sorted(f.getPath().toString() for f in found)


def merge(*reports: DataFrame) -> DataFrame:
    """Reports of several inputs in their order: part and ord, then all columns; missing ones are null."""
    parts = [r.withColumn("part", F.lit(i)) for i, r in enumerate(reports)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_records(records: DataFrame, path: str, order: str) -> None:
    """JSON lines in the order of ``order``, fields that are null kept."""
    fields = F.struct(*[c for c in records.columns if c != order])
    records.orderBy(order).select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_merged(reports: DataFrame, path: str, order: str, report: str = "report") -> None:
    """JSON lines of report strings."""
    reports.orderBy(order).select(F.col(report).alias("value")).write.mode("overwrite").text(path)

"""Curated sets: rules with a ledger of what they reject, one row of each canonical form, a data card.

An own design: of the original's export command only the options are known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATE = "duplicate"
LETTER, LETTER_OR_DIGIT = r"\p{L}", r"[\p{L}\p{N}]"


@dataclass(frozen=True)
class Rule:
    """A row is broken by the rule where ``broken`` holds; null is not broken."""

    name: str
    broken: Column


def standard_rules(text: str = "text", least_chars: int = 20, most_chars: int = 100_000) -> list[Rule]:
    """Nothing said, too short or long, less than half letters, characters that a decoder gave up on, templates that were never filled in."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.length(t)
    return [
        Rule("blank", ~t.rlike(LETTER_OR_DIGIT)),
        Rule("short", n < least_chars),
        Rule("long", n > most_chars),
        Rule("letters", 2 * F.length(F.regexp_replace(t, rf"[^{LETTER}]", "")) < n),
        Rule("undecoded", t.contains("�")),
        Rule("template", t.rlike(r"\{\{|\}\}|\[\[|\]\]")),
    ]


def canonical(text: Column) -> Column:
    """Letters and digits in lower case, anything between them as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@dataclass
class Curated:
    """``kept``: rows of the curated set; ``ledger``: id, rule and, for duplicates, the id that stands for it (``of``); ``marked``: all rows with violations, of and kept."""

    kept: DataFrame
    ledger: DataFrame
    marked: DataFrame


def curate(rows: DataFrame, rules: list[Rule] | None = None, keep_invalid: bool = False, id: str = "doc_id", text: str = "text") -> Curated:
    """Rows that break no rule (all, with ``keep_invalid``), one of each canonical form: that of the longest text, then of the smallest id.

    A form is compared by its SHA-256.  Forms are elected by aggregation and
    only those of several rows come back to the rows, so a form that fills the
    table is one row in that join.  Texts without a letter or digit have no
    form and stand alone; ids should be unique, rows that share one and a form
    are kept or dropped together.
    """
    rules = standard_rules(text) if rules is None else rules
    columns = rows.columns
    broken = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    form = canonical(F.col(text).cast("string"))
    out = rows.withColumn("violations_", broken).withColumn("form_", F.when(form != "", F.sha2(form, 256)))
    out = out.withColumn("fit_", F.lit(True) if keep_invalid else F.size("violations_") == 0)
    rank = F.struct((-F.length(F.col(text))).alias("size"), F.col(id).alias("id"))
    forms = out.where(F.col("fit_") & F.col("form_").isNotNull()).groupBy("form_").agg(F.count("*").alias("n"), F.min(rank)["id"].alias("of_"))
    several = forms.where("n > 1").select("form_", "of_")
    out = out.join(several, "form_", "left")
    again = F.col("fit_") & F.col("of_").isNotNull() & ~F.col(id).eqNullSafe(F.col("of_"))
    out = out.select(*[F.col(f"`{c}`") for c in columns], F.col("violations_").alias("violations"), F.when(again, F.col("of_")).alias("of"), (F.col("fit_") & ~again).alias("kept"))
    told = F.concat(F.transform("violations", lambda v: F.struct(v.alias("rule"), F.lit(None).cast(rows.schema[id].dataType).alias("of"))), F.when(F.col("of").isNotNull(), F.array(F.struct(F.lit(DUPLICATE).alias("rule"), F.col("of").alias("of")))).otherwise(F.array().cast(f"array<struct<rule:string,of:{rows.schema[id].dataType.simpleString()}>>")))
    ledger = out.select(F.col(id), F.explode(told).alias("t")).select(id, "t.rule", "t.of")
    return Curated(out.where("kept").select(*[F.col(f"`{c}`") for c in columns]), ledger, out)


def card(curated: Curated, sections: list[str], text: str = "text") -> DataFrame:
    """section, value, rows, kept, broken, duplicates, chars (of kept texts): in all and by each column of ``sections``, counted in one pass by grouping sets."""
    rows = curated.marked.select(*sections, "violations", "of", "kept", F.length(F.col(text)).cast("long").alias("n_"))
    sets = [[], *[[F.col(s)] for s in sections]]
    counts = [
        F.count("*").alias("rows"), F.count_if("kept").alias("kept"), F.count_if(F.size("violations") > 0).alias("broken"),
        F.count_if(F.col("of").isNotNull()).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("n_"))), F.lit(0)).alias("chars"),
    ]
    which = F.when(F.grouping(sections[0]) == 0, F.lit(sections[0])) if sections else F.lit("all")
    for s in sections[1:]:
        which = which.when(F.grouping(s) == 0, F.lit(s))
    which = which.otherwise("all") if sections else which
    value = F.coalesce(*[F.col(s).cast("string") for s in sections]) if sections else F.lit(None).cast("string")
    got = rows.groupingSets(sets, *[F.col(s) for s in sections]).agg(which.alias("section"), *counts) if sections else rows.agg(which.alias("section"), *counts)
    return got.select("section", value.alias("value"), "rows", "kept", "broken", "duplicates", "chars")


def card_text(counted: DataFrame, ledger: DataFrame, title: str) -> str:
    """The data card as Markdown: a table a section and the rules' counts; its rows are few and are collected."""
    out = [f"# {title}", ""]
    rows = counted.orderBy("section", F.desc("rows"), "value").collect()
    for section in dict.fromkeys(r.section for r in rows):
        out += [f"## {section}", "", "| value | rows | kept | broken | duplicates | characters |", "|-|-|-|-|-|-|"]
        out += [f"| {r.value if r.value is not None else '-'} | {r.rows} | {r.kept} | {r.broken} | {r.duplicates} | {r.chars} |" for r in rows if r.section == section] + [""]
    out += ["## rules", "", "| rule | rows |", "|-|-|"]
    out += [f"| {r.rule} | {r.n} |" for r in ledger.groupBy("rule").agg(F.count("*").alias("n")).orderBy("rule").collect()]
    return "\n".join(out) + "\n"

"""Numbers in dirty JSON: types are asked for, never coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_number_strict(v: Column) -> Column:
    """Number, but not boolean."""
    return F.coalesce(kind(v).isin("BIGINT", "DOUBLE", "FLOAT") | kind(v).startswith("DECIMAL"), F.lit(False))


def is_number_loose(v: Column) -> Column:
    """Number or boolean (as 1 and 0)."""
    return is_number_strict(v) | F.coalesce(kind(v) == "BOOLEAN", F.lit(False))


def number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))

"""String and rounding functions with Python's semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what str.isspace and str.splitlines recognise
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NO_SPACE = SPACE.replace("[", "[^")
BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"

TWO_60 = 1 << 60


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """str.strip().  The last pattern is tried all along a text, so only texts with white space at an end are searched."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(SPACE), F.regexp_replace(F.regexp_replace(text, rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")).otherwise(text)


def blank(text: Column) -> Column:
    """not str.strip()."""
    return ~text.rlike(NO_SPACE)


def splitlines(text: Column) -> Column:
    """str.splitlines(): a trailing break makes no empty line, '' has no lines."""
    parts = F.split(text, BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapse(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def ascii_digits(text: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def round2(x: Column) -> Column:
    """round(x, 2): half to even on the exact binary value, for every double; NaN and infinities stay.

    The fraction, scaled by 2**60, is a whole number from 2**-8 on, so its
    hundredths and the remainder are exact.  Smaller ones round to 0 or, from
    0.005 on, to 0.01.  Doubles of 2**52 and more have no fraction.
    """
    size, d = F.abs(x), F.lit(TWO_60).cast("decimal(20,0)")
    whole = F.floor(F.when(size < F.lit(float(1 << 52)), size)).cast("bigint")
    m = ((size - whole) * F.lit(float(TWO_60))).cast("bigint").cast("decimal(20,0)") * 200 + d
    up = F.call_function("div", m, d * 2)  # to nearest, ties up
    down = F.when((m % (d * 2) == 0) & (up % 2 == 1), 1).otherwise(0)  # ties to even
    cents = whole.cast("decimal(20,0)") * 100 + up - down
    return F.when(whole.isNull(), x).otherwise(F.signum(x) * (cents / F.lit(100).cast("decimal(3,0)")).cast("double"))

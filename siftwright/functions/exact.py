"""Moments of doubles without rounding: a number is cut into whole limbs, whose sums and products are added as decimals."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: limbs of a number and bits of each: a double below 2**30 and, if it is not 0, of 2**-37 or more in size is cut without a rest
LIMBS, BITS = 4, 30
_PAIRS = [(i, j) for i in range(LIMBS) for j in range(i, LIMBS)]


def limbs(x: Column) -> Column:
    """Whole numbers l with x = l[0] + l[1] / 2**30 + l[2] / 2**60 + ...; every step is exact."""
    start = F.struct(F.array().cast("array<bigint>").alias("l"), x.alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        whole = F.floor(acc["rest"])
        return F.struct(F.array_append(acc["l"], whole).alias("l"), ((acc["rest"] - whole) * float(1 << BITS)).alias("rest"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LIMBS)), start, step, lambda acc: acc["l"])


def sums(of: str) -> list[Column]:
    """Aggregates of a column of limbs(): how many, and the sums of limbs and of their products, as text."""
    big = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("string")
    at = lambda i: F.get(of, F.lit(i))
    ones, twos = [big(at(i)) for i in range(LIMBS)], [big(at(i) * at(j)) for i, j in _PAIRS]
    return [F.count(of).alias(f"{of}_n"), F.array(*ones).alias(f"{of}_s"), F.array(*twos).alias(f"{of}_p")]


def _total(parts) -> Fraction:
    return reduce(lambda a, x: a + Fraction(int(x[1]), 1 << (BITS * x[0])), enumerate(parts), Fraction(0))


def root(x: Fraction) -> float:
    """The square root, correctly rounded."""
    if not x:
        return 0.0
    shift = max(0, 64 + (x.denominator.bit_length() - x.numerator.bit_length()) // 2 + 1)
    scaled, rest = divmod(x.numerator << (2 * shift), x.denominator)
    r = isqrt(scaled)
    return (2 * r + (r * r != scaled or rest != 0)) / (1 << (shift + 1))  # the last bit tells that something follows


@F.pandas_udf(DoubleType())
def mean(n: pd.Series, s: pd.Series) -> pd.Series:
    """The sum, rounded once, over the number; null for none."""
    return pd.Series([float(_total(x)) / k if k else None for k, x in zip(n, s, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def deviation(n: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
    """The sample's standard deviation, rounded once; 0 for fewer than two."""
    out = []
    for k, ones, twos in zip(n, s, p, strict=True):
        if k < 2:
            out.append(0.0)
            continue
        square = sum((Fraction((2 - (i == j)) * int(x), 1 << (BITS * (i + j))) for (i, j), x in zip(_PAIRS, twos, strict=True)), Fraction(0))
        out.append(root((square - _total(ones) ** 2 / k) / (k - 1)))
    return pd.Series(out, dtype="float64")

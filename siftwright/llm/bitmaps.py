"""Filters of a fixed size, built by aggregation and tested where rows are read; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: bits of a filter (4 MB); a full filter only lets more rows through
FILTER_BITS = 1 << 25


def _slot(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(FILTER_BITS)) + 1


def bitmap(rows: DataFrame, *of: str) -> DataFrame:
    """Stored bitmap (bucket, bits) of the columns' hashes: FILTER_BITS in all."""
    slot = _slot(*of)
    return stored(rows.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")), "filter")


def tested(rows: DataFrame, bits: DataFrame, out: str, *of: str) -> DataFrame:
    """rows with ``out``: whether the filter may hold the columns' values (named and typed as when it was built)."""
    slot = _slot(*of)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket", "left").withColumn(out, held).drop("bucket", "bits")

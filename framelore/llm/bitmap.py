"""A bitmap of keys with a fixed size, for semi-joins that do not shuffle wide rows.

Keys are hashed to ``BITS`` bits in rows of 4 KB. The bitmap has at most 4 MB at any
input size, so it is broadcast by construction. A bit may be set by another key,
never missed: rows that hit it are joined exactly afterwards. More keys than bits
only mean more rows for that exact join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 25


def slot(*by: str | Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(BITS))


def bitmap(slots: DataFrame) -> DataFrame:
    """(_bucket, _bits) of a frame with one column of slots."""
    k = slots.columns[0]
    return slots.groupBy(F.bitmap_bucket_number(k).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("_bits"))


def with_hit(rows: DataFrame, marks: DataFrame, key: Column, hit: str = "_hit") -> DataFrame:
    """Adds whether the bit of ``key`` is set; ``marks`` is broadcast (see the module text for its size)."""
    position = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    looked = (rows.withColumn("_slot", key).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
              .join(F.broadcast(marks), "_bucket", "left"))
    return looked.withColumn(hit, F.coalesce(F.floor(byte / F.pow(F.lit(2), position % 8)).cast("int") % 2 == 1, F.lit(False))).drop("_slot", "_bucket", "_bits")


def keep_matching(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` whose ``on`` is in ``keys`` (one column of that name, distinct); only rows that hit the bitmap are shuffled."""
    marks = bitmap(keys.select(slot(on).alias("_k")))
    hit = with_hit(rows, marks, slot(on)).filter("_hit").drop("_hit")
    other = keys.select(F.col(on).alias("_other"))
    return hit.join(other, F.col(on).eqNullSafe(F.col("_other")), "left_semi")


def drop_matching(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` whose ``on`` is not in ``keys``; rows that miss the bitmap stay where they are."""
    marks = bitmap(keys.select(slot(on).alias("_k")))
    looked = with_hit(rows, marks, slot(on))
    other = keys.select(F.col(on).alias("_other"))
    doubtful = looked.filter("_hit").drop("_hit").join(other, F.col(on).eqNullSafe(F.col("_other")), "left_anti")
    return looked.filter("not _hit").drop("_hit").unionByName(doubtful)

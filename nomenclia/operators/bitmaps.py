"""Which positions have a characteristic or an option, as bitmaps.

Positions are numbered densely, and each characteristic has a bit for each of
them, in blocks of Spark's bitmap size. The positions that have several are the
bits that all of their bitmaps have: one aggregate a block, whatever the number
of positions, where a semi-join would move a row for each. Counts are bit counts.

Blocks are rows, so a characteristic that every position has is spread like any
other, and a bitmap is built in parts that merge.

Cases: null keys and positions are dropped; repeated rows are one bit; a key
that is asked for twice counts once; a set of which a key is unknown has no
positions; an empty set of keys is no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of numbers that one task gives out.
BLOCK = 100_000


def numbered(codes: DataFrame) -> DataFrame:
    """(code, number) of ``codes`` (code): distinct codes, numbered from 1 in their order within hashed blocks.

    Blocks are counted first, so that no task sees all codes.
    """
    blocks = max(1, codes.count() // BLOCK)
    dealt = codes.where("code is not null").select("code").distinct().withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)))
    sizes = dealt.groupBy("block").agg(F.count("*").alias("n"))
    first = sizes.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("code"))
    return dealt.withColumn("place", place).join(first, "block").select("code", (F.col("first") + F.col("place")).cast("long").alias("number"))


def build(having: DataFrame, numbers: DataFrame) -> DataFrame:
    """(key, block, bits) of ``having`` (key, code)."""
    n = F.col("number")
    rows = having.where("key is not null").join(numbers, "code")
    return rows.groupBy("key", F.bitmap_bucket_number(n).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def all_of(bitmaps: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, block, bits) of the positions that have all keys of each of ``sets`` (set, keys array)."""
    asked = sets.select("set", F.explode(F.array_distinct("keys")).alias("key"), F.size(F.array_distinct("keys")).alias("size"))
    met = asked.join(bitmaps, "key").groupBy("set", "size", "block").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return met.where("n = size").select("set", "block", "bits")


def counts(found: DataFrame) -> DataFrame:
    """(set, n) of ``found``, of ``all_of``; sets without positions are not there."""
    return found.groupBy("set").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")


def positions(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """(set, code) of ``found``: the bits looked up by the positions' numbers, block by block."""
    n = F.col("number")
    at = numbers.select("code", F.bitmap_bucket_number(n).alias("block"), F.bitmap_bit_position(n).alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.join(at, "block").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select("set", "code")

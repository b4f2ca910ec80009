"""Rows that may be among wanted keys, by bitmaps of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap per row, and the least and most pieces of 32,768 bits it may have: 64 kB to 64 MB in all.
BITS_PER_ROW, PIECES = 4, (16, 16_384)


def pieces_for(rows: int) -> int:
    """Pieces of a bitmap for so many rows, within bounds."""
    return int(min(max(rows * BITS_PER_ROW // 32_768, PIECES[0]), PIECES[1]))


def among(df: DataFrame, key: Column, wanted: DataFrame, pieces: int) -> DataFrame:
    """Rows of ``df`` whose key may be among ``wanted(k)``, 64-bit hashes of keys; surely none that is.

    The hashes set bits of a bitmap of bounded size (``pieces`` of 4 kB), which is broadcast and tested in the scan, so rows that
    do not pass are never shuffled. The more bits are set, the more rows pass needlessly; what passes is to be compared exactly.
    """
    bits = pieces * 32_768
    slot = F.pmod(F.col("k"), F.lit(bits))
    bitmap = wanted.select((slot / 32_768).cast("int").alias("_faultloom_piece"), (slot % 32_768).cast("long").alias("bit")).groupBy("_faultloom_piece").agg(F.bitmap_construct_agg("bit").alias("_faultloom_bits"))
    placed = df.withColumn("_faultloom_slot", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("_faultloom_piece", (F.col("_faultloom_slot") / 32_768).cast("int"))
    place = (F.col("_faultloom_slot") % 32_768).cast("int")
    byte = F.conv(F.hex(F.substring("_faultloom_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1
    return placed.join(F.broadcast(bitmap), "_faultloom_piece").filter(hit).drop("_faultloom_slot", "_faultloom_piece", "_faultloom_bits")

"""A filter of ids made at run time: which rows of a large table can have a partner in a small one.

The ids of the small side are hashed to ``2**bits`` places; a place is a bit of a row of 4 KB bitmaps, so the whole
filter has at most ``2**bits / 32768`` rows, whatever the ids are (2,048 rows and 8 MB for 26 bits), and may be broadcast.
The large side is asked row by row, before any costly work on it. An id of the small side always passes; another
one passes with the share of set places, and is for a later join to drop. Built-in functions only, with partial
aggregation: no id is collected, no shuffle of the large side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
_WORD = 15  # a bitmap holds 2**15 places


def _place(ids: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*ids), F.lit(1 << bits))


def id_filter(small: DataFrame, id_cols, bits: int = BITS) -> DataFrame:
    """(_bucket, _bitmap): the places of the ids in ``small``."""
    place = _place([F.col(c) for c in id_cols], max(bits, _WORD))
    return (small.select(place.alias("_place"))
            .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bitmap")))


def may_be_in(large: DataFrame, filter_rows: DataFrame, id_cols, bits: int = BITS) -> DataFrame:
    """The rows of ``large`` whose id has its place set in ``filter_rows`` (from ``id_filter`` with the same bits)."""
    place = _place([F.col(c) for c in id_cols], max(bits, _WORD))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    asked = large.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    met = asked.join(F.broadcast(filter_rows), "_bucket")  # at most 2**bits / 32768 rows
    return met.where(F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1).select(*large.columns)

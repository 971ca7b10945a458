"""A filter of keys with a fixed size, in DataFrame functions only.

A key sets one of 2 ** 27 bits, kept as at most 4,096 bitmaps of 4 KB.  Rows whose bit is not set have no
match in the keys and need no join, hence no exchange; the others are joined as usual.  When more keys
come than bits, more rows pass the filter and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize

#: Bits of one bitmap (Spark's bitmap functions have this many) and number of bitmaps.
BITS, BITMAPS = 32_768, 4_096


def place(key: Column) -> Column:
    """The bit of a key among all."""
    return F.pmod(F.xxhash64(F.lit("filter"), key), F.lit(BITS * BITMAPS))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(_map, _bits): the bitmaps of a table of keys, 16 MB at most."""
    places = keys.select(place(F.col(key)).alias("p"))
    maps = places.groupBy(F.expr(f"p div {BITS}").alias("_map")).agg(F.bitmap_construct_agg(F.col("p") % BITS).alias("_bits"))
    return materialize(maps, "key-filter")


def split_by_filter(rows: DataFrame, key: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that surely have none of the keys, and those that may have one."""
    bit = F.col("_place") % BITS
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("_bits").isNotNull() & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    marked = rows.withColumn("_place", place(F.col(key))).withColumn("_map", F.expr(f"_place div {BITS}"))
    marked = marked.join(F.broadcast(known), "_map", "left")
    return tuple(marked.where(c).drop("_map", "_place", "_bits") for c in (~hit, hit))

"""A table of bits that tells most rows that a join would drop, before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a row of the table, which has at most ``MOST`` bits (16 MB) whatever the number of keys.
ROW, LEAST, MOST = 1 << 15, 1 << 20, 1 << 27
#: Bits for each key, as long as there is room.
BITS_A_KEY = 64


def bits_for(n: int) -> int:
    """Bits of a table for ``n`` keys: a power of two."""
    return min(MOST, max(LEAST, 1 << (BITS_A_KEY * max(n, 1) - 1).bit_length()))


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(key, F.lit(bits))
    return F.floor(at / ROW).cast("int"), (at % ROW).cast("int")


def sift(rows: DataFrame, key: str, keys: DataFrame, bits: int) -> DataFrame:
    """The rows whose 64-bit hash ``key`` may be one of ``keys`` (key); none that is one is lost.

    The table is sent to all tasks: its size is ``bits``, however many keys
    there are. With as many keys as bits nothing is ruled out, which costs
    time, but no row. Null keys are left out.
    """
    row, at = _place(F.col(key), bits)
    table = keys.filter(F.col(key).isNotNull()).select(row.alias("__row"), at.cast("long").alias("__at")).groupBy("__row").agg(
        F.bitmap_construct_agg("__at").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(table), row == F.col("__row"))
    return joined.filter(F.call_function("shiftright", byte, at % 8).bitwiseAND(1) == 1).drop("__row", "__bits")

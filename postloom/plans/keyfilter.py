"""A bitmap of keys that drops most rows without a partner before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and of the largest bitmap: 128 MB, the most that is broadcast.
KEY_BITS = 16
MAX_BITS = 1 << 30

BLOCK_BITS = 1 << 15


def _position(columns: Sequence[str], bits: int) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit(bits - 1))


def _bits(n: int) -> int:
    bits = BLOCK_BITS
    while bits < KEY_BITS * n and bits < MAX_BITS:
        bits *= 2
    return bits


def keep_partners(rows: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose ``columns`` may be among those of ``keys``.

    No row with a partner is lost; of the others about one in ``KEY_BITS`` stays,
    so a join still has to follow. The keys' hashes set bits of a bitmap in blocks
    of 4 KB, which are broadcast. ``MAX_BITS`` bounds them: with more than 67
    million keys the bitmap fills up and lets more rows through.
    """
    kept = rows.columns
    bits = _bits(keys.count())
    position = _position(columns, bits)
    blocks = keys.groupBy(F.shiftright(position, 15).alias("_block")).agg(
        F.bitmap_construct_agg(position.bitwiseAND(F.lit(BLOCK_BITS - 1))).alias("_bits")
    )
    offset = _position(columns, bits).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(offset, 3) + F.lit(1), F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("_block", F.shiftright(position, 15))
        .join(F.broadcast(blocks), "_block")
        .withColumns({"_byte": byte, "_bit": offset.bitwiseAND(F.lit(7))})
        .where(F.expr("shiftright(_byte, _bit) & 1") == 1)
        .select(*kept)
    )

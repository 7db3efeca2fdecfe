"""Hex image hashes and their bit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_hex(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]+$"), F.lit(False))


def _word(c: Column, start) -> Column:
    """Eight hex digits as BIGINT; a whole 64-bit value would overflow ``conv``."""
    return F.conv(F.substring(c, start, 8), 16, 10).cast("bigint")


def hash_bits(c: Column) -> Column:
    """The first 16 hex digits (shorter hashes are zero-filled on the left) as a BIGINT."""
    padded = F.lpad(F.substring(c, 1, 16), 16, "0")
    return F.when(is_hex(c), F.shiftleft(_word(padded, 1), 32).bitwiseOR(_word(padded, 9)))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two equally long hex texts of any length, else null."""
    words = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / 8).cast("int"))

    def differing(i):
        at = i * 8 + 1
        return F.bit_count(
            F.conv(F.substring(a, at, F.lit(8)), 16, 10).cast("bigint").bitwiseXOR(
                F.conv(F.substring(b, at, F.lit(8)), 16, 10).cast("bigint")
            )
        )

    short = F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))
    long = F.aggregate(F.transform(words, differing), F.lit(0), lambda acc, x: acc + x)
    comparable = (F.length(a) == F.length(b)) & (F.length(a) > 0) & is_hex(a) & is_hex(b)
    return F.when(comparable, F.when(F.length(a) <= 16, short).otherwise(long))

"""Rupees and the way they are printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_half_even

TONNES = "decimal(18,3)"


def rupees(tonnes: Column, rate: Column) -> Column:
    """Whole rupees, halves to even."""
    return F.bround(tonnes * rate, 0).cast("bigint")


def lakh(amount: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", round_half_even(amount.cast("double") / 100000, digits))


def indian_group(whole: Column) -> Column:
    """1240000 to 12,40,000."""
    return F.regexp_replace(whole.cast("bigint").cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")

"""Decimal rounding of the exact binary value, halves to even.

Spark rounds a double by its printed digits, so 0.5065 becomes 0.507 although the
stored value is a little below the half. Results here must follow the stored value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_SPLIT = 134_217_729.0  # 2**27 + 1 separates a double into two exact halves


def rounded(x: Column, digits: int) -> Column:
    """``x`` must be cheap to repeat: a column or a bound value."""
    scale = float(10**digits)
    product = x * scale
    high = x * _SPLIT - (x * _SPLIT - x)
    # What the multiplication itself rounded off, exactly.
    lost = (high * scale - product) + (x - high) * scale
    down = F.floor(product)
    on_half = (product - down == 0.5) & (lost != 0)
    whole = F.when(on_half, F.when(lost > 0, down + 1).otherwise(down)).otherwise(F.rint(product))
    return F.when(F.abs(x) < 1e12, whole / scale).otherwise(x)


def round_half_even(x: Column, digits: int) -> Column:
    return let(x.cast("double"), lambda v: rounded(v, digits))

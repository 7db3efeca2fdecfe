"""Lenient readings of model output and strict checks of supplied numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .binding import let, let_all
from .rounding import round_half_even

# Words read as numbers or truth values.
TRUE_WORDS = ["true", "yes", "y", "1"]
FALSE_WORDS = ["false", "no", "n", "0"]
CONFIDENCE_WORDS = {"high": 0.85, "medium": 0.6, "moderate": 0.6, "low": 0.3}


def kind_of(v: Column) -> Column:
    """'bool', 'text', 'number' or 'other' for a VARIANT scalar; null for SQL NULL."""
    name = F.schema_of_variant(v)
    return (
        F.when(name == "BOOLEAN", F.lit("bool"))
        .when(name == "STRING", F.lit("text"))
        .when(name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit("number"))
        .otherwise(F.lit("other"))
    )


def _scalar(v: Column, body) -> Column:
    return let_all(
        body,
        kind=kind_of(v),
        word=F.lower(text.strip(F.try_variant_get(v, "$", "string"))),
        number=F.try_variant_get(v, "$", "double"),
        flag=F.try_variant_get(v, "$", "boolean"),
    )


def coerce_bool(v: Column) -> Column:
    """``struct<value,ok>`` of a VARIANT."""

    def read(s):
        worded = s["kind"] == "text"
        value = (
            F.when(s["kind"] == "bool", s["flag"])
            .when(worded & s["word"].isin(TRUE_WORDS), F.lit(True))
            .when(worded & s["word"].isin(FALSE_WORDS), F.lit(False))
            .when(s["kind"] == "number", s["number"] != 0)
        )
        return F.struct(F.coalesce(value, F.lit(False)).alias("value"), value.isNotNull().alias("ok"))

    return _scalar(v, read)


def _unit_interval(number: Column) -> Column:
    percent = F.when(number > 100, F.lit(1.0)).when(number > 1, number / 100.0).otherwise(number)
    return round_half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent)), 3)


def coerce_confidence(v: Column) -> Column:
    """``struct<value,ok>`` of a VARIANT: 85 means 85 %, words are read but not ok."""
    spoken = F.create_map(*[F.lit(x) for kv in CONFIDENCE_WORDS.items() for x in kv])

    def read(s):
        number = F.when(s["kind"] == "number", s["number"]).when(s["kind"] == "text", s["word"].try_cast("double"))
        by_word = F.when(s["kind"] == "text", F.try_element_at(spoken, F.coalesce(s["word"], F.lit(""))))
        return F.struct(
            F.coalesce(by_word, F.when(number.isNotNull(), _unit_interval(number)), F.lit(0.0)).alias("value"),
            (by_word.isNull() & number.isNotNull()).alias("ok"),
        )

    return _scalar(v, read)


def check_number(c: Column, low=None, high=None, low_inclusive: bool = True) -> Column:
    """Error text of a DOUBLE column, null when it is acceptable."""
    checks = F.when(c.isNull(), F.lit("must be a number")).when(
        F.isnan(c) | (F.abs(c) == math.inf), F.lit("must be a finite number")
    )
    if low is not None:
        below = (c < low) if low_inclusive else (c <= low)
        checks = checks.when(below, F.lit(f"must be {'at least' if low_inclusive else 'more than'} {low:g}"))
    if high is not None:
        checks = checks.when(c > high, F.lit(f"must be at most {high:g}"))
    return checks


def check_lonlat(p: Column) -> Column:
    """Error text of a point."""
    return F.coalesce(
        F.when(p.isNull(), F.lit("must be [longitude, latitude]")),
        check_number(p["lon"], -180, 180),
        check_number(p["lat"], -90, 90),
        F.when((p["lon"] == 0) & (p["lat"] == 0), F.lit("[0, 0] is not a real location")),
    )


def check_line(line: Column, min_points: int, max_points: int) -> Column:
    """Error text of a line: its length, else its first bad point."""
    bad = F.filter(
        F.transform(
            line,
            lambda p, i: F.concat(F.lit("point "), (i + 1).cast("string"), F.lit(" "), check_lonlat(p)),
        ),
        lambda e: e.isNotNull(),
    )
    sized = F.size(line).between(min_points, max_points)
    return (
        F.when(line.isNull(), F.lit("must be a list of [longitude, latitude] points"))
        .when(~sized, F.lit(f"must have between {min_points} and {max_points} points"))
        .otherwise(F.get(bad, F.lit(0)))
    )


def closed_line(line: Column) -> Column:
    """Coordinates to 7 decimals; the first vertex repeated at the end when it is open."""
    from . import geo

    return let(
        F.transform(line, lambda p: geo.pt(F.round(p["lon"], 7), F.round(p["lat"], 7))),
        lambda r: F.when(
            F.get(r, F.lit(0)) != F.get(r, F.size(r) - 1), F.concat(r, F.slice(r, F.lit(1), F.lit(1)))
        ).otherwise(r),
    )

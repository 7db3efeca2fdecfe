"""Name an intermediate value once. Reusing a Python ``Column`` copies its whole
expression; binding it to a lambda variable keeps long parsers linear in size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(body: Callable[[Column], Column], **values: Column) -> Column:
    """Bind several values as the fields of one struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)

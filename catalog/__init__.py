"""Registered queries over the driver's tables, each with an independent SQL statement."""

from . import bill, cases, functions, ledger, quality, sources  # noqa: F401
from .registry import QUERIES, statements  # noqa: F401

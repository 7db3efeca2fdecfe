from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named subquery other statements may use."""
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """``sql`` with every view it mentions, directly or not, as a WITH clause."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed) + "\n" + sql.strip()


def statements() -> dict[str, str]:
    """Every query's complete statement."""
    return {name: with_views(sql) for name, sql in ORACLE.items()}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id, with its SQL when there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register

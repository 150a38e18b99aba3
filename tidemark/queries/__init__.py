"""Registered queries: each binds an operator to the test tables, beside its SQL.

Binding: parts are the ranked items, customers the users, line items the interactions
(a returned line is a ``return``, any other a ``purchase``), orders the groups.  A
request is every part whose key is divisible by 20, seeded with it and the two after
it, or every customer.  The clock stands at 2001-08-02.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under a name, with the SQL it is compared with."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = "WITH " + sql if not sql.lstrip().upper().startswith(("WITH", "SELECT")) else sql
        return f

    return add


def load() -> None:
    for module in ("scans", "similarities", "signals", "filters", "ranking", "learned", "control", "planned"):
        import_module(f"tidemark.queries.{module}")

"""Queries by name, each with the SQL that must give the same rows, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, money: str = "", dates: str = "", longs: str = "", given: str = ""):
    """Register a function of (spark, sf_dir). ``sql`` may use the views of ``views.SQL_VIEWS``, which are put before it.

    Engines hand decimals and dates to clients as different types, and sums of integers as different widths: columns named in
    ``money`` and ``dates`` are given as text by both, those in ``longs`` as 64-bit integers. Those in ``given`` the query gives as this text itself.
    """
    kinds = {c: ("decimal(38,12)", True) for c in money.split()} | {c: ("date", True) for c in dates.split()} | {c: ("bigint", False) for c in longs.split()}

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name

        def run(spark, sf_dir):
            from ..session import ship

            ship(spark)
            out = f(spark, sf_dir)
            return out.withColumns({c: out[c].cast(kind).cast("string") if text else out[c].cast(kind) for c, (kind, text) in kinds.items() if c not in given.split()})

        QUERIES[name] = wraps(f)(run)
        if sql is not None:
            from .views import with_views

            casts = ", ".join(f"CAST(CAST({c} AS {kind}) AS VARCHAR) AS {c}" if text else f"CAST({c} AS {kind}) AS {c}" for c, (kind, text) in kinds.items())
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({with_views(sql)})" if kinds else with_views(sql)
        return f

    return add

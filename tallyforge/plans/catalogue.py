"""All registered queries of the reconciliation library."""

from __future__ import annotations

from . import core_queries, domain_queries, ledger_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

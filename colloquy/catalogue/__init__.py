"""Queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from . import archive, identity, intervals, talk, words  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

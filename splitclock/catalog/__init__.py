"""All named queries. Importing a module of this package registers its queries."""

from __future__ import annotations

from splitclock.catalog import external, history, predictions, records, routes, scalars, tables  # noqa: F401
from splitclock.catalog.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

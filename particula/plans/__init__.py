"""Registered queries (Spark plan + DuckDB oracle text)."""

from . import alerting, core, features, learning, reporting  # noqa: F401  (registration side effects)
from .base import REGISTRY, Query  # noqa: F401


def queries():
    return {n: q.build for n, q in REGISTRY.items()}


def oracle_sql():
    return {n: q.sql for n, q in REGISTRY.items() if q.sql}

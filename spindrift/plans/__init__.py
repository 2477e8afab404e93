"""Queries over the driver tables, with DuckDB SQL beside each."""

from spindrift.plans import careers, documents, feed, more, relations, rules, scoring, sources, state, text  # noqa: F401
from spindrift.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

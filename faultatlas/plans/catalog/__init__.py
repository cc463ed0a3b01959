"""Registered queries, each next to the SQL that checks it.

``QUERIES[name]`` is ``(callable(spark, sf_dir), sql or None)``.  The SQL never
sees the text a query parses: it works on the columns the text was made from.
"""

from faultatlas.plans.catalog.registry import QUERIES
from faultatlas.plans.catalog import (  # noqa: F401  (imported for registration)
    findings,
    gates,
    graph,
    memory,
    patches,
    planning,
    reports,
    sources,
    streams,
)

__all__ = ["QUERIES"]

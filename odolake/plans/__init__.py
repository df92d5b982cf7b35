"""Queries over the driver tables, each with the SQL that gives the same rows."""


def all_queries():
    """(queries, SQL) by name."""
    from . import cohort_reports, comparisons, drives, series  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES

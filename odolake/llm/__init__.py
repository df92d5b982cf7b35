"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""


def all_llm_queries():
    """(queries, SQL) by name."""
    from .queries import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)

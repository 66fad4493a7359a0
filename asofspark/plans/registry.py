"""Registered queries by operator id, and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views under an operator id; sql may name the views of plans.views."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return register


from . import accounts, contracts_and_pairs, evidence, features, identity, outcomes, quality, sources, streams  # noqa: E402, F401

"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import bodies, decks, documents, events, extended, forms, lookups, markup, metrics, more, papers, profiles, references, reports, repository, search, slides, streams, structure  # noqa: F401  (they register their queries)
from lectern.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

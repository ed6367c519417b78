"""Registration of queries next to the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwatch.plans.sqlviews import with_views

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, views: tuple[str, ...] = (), name: str | None = None):
    """Register a plan; ``oracle`` is SQL over the driver's tables and the named views."""

    def register(plan: Plan) -> Plan:
        key = name or plan.__name__
        QUERIES[key] = plan
        if oracle is not None:
            ORACLES[key] = with_views(oracle, views)
        return plan

    return register

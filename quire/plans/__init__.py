"""The registered queries: an operator on its inputs, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import discovery, fields, jobs, scoring
from quire.session import bound_batches
from quire.views import Inputs, with_views

PLANS = discovery.PLANS | jobs.PLANS | fields.PLANS | scoring.PLANS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bounded(f) for name, (f, _) in PLANS.items()}


def _bounded(plan: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return plan(Inputs(spark, sf_dir))

    return run


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in PLANS.items() if sql}

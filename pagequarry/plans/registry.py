"""Named queries: a Spark plan and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequarry.plans.views import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def plan(sql: str | None = None):
    """Register the function under its own name."""

    def add(fn: Callable[[Tables], DataFrame]):
        PLANS[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = " ".join(sql.split("\n")).strip()
        return fn

    return add


def runnable(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run

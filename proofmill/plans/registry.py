"""Registry of queries: a Spark plan and, where SQL can say it, an equivalent query."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession

from proofmill.plans.views import Inputs, with_views
from proofmill.session import configure

PLANS: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ["discovery", "assessment", "corpus", "style", "relations", "windows", "evidence", "review", "evaluation"]


def query(key: str, sql: str | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        PLANS[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql, "duck")
        return fn

    return register


def load() -> None:
    for module in MODULES:
        if find_spec(f"proofmill.plans.{module}"):
            import_module(f"proofmill.plans.{module}")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn: Callable[[Inputs], DataFrame]):
        return lambda spark, folder: fn(Inputs(configure(spark), folder))

    return {key: bind(fn) for key, fn in PLANS.items()}


def oracle_queries() -> dict[str, str]:
    load()
    return dict(ORACLES)


def oracle_view(name: str, sql: str) -> None:
    """An intermediate relation used by comparison queries only (names start with o_)."""
    from proofmill.plans.views import VIEWS

    VIEWS[name] = {"duck": sql}

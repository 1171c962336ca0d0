"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakeops.plans.fixtures import Tables, with_views


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with its SQL check if there is one."""

    def add(build: Callable[[Tables], DataFrame]):
        if build.__name__ in REGISTRY:
            raise ValueError(f"{build.__name__} is registered twice")
        REGISTRY[build.__name__] = Query(build, with_views(sql) if sql else None)
        return build

    return add

"""Registered queries: a Spark builder, and SQL for the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gazeframe.session import prepare

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its function name; ``covers`` lists inventory ids."""

    def register(build: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir.rstrip("/"))

        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, covers, run, sql)
        return build

    return register

"""Where queries register: name, operators covered, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)


def query(name: str, covers: str, sql: str | None = None) -> Callable:
    """Registers a function of the tables as a query. Without ``sql`` it is tested against brute force instead."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, directory: f(Tables(spark, directory))
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return f

    return register

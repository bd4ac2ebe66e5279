"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cindertrace.plans.adapter import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def wrap(f: Callable[[Tables], DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = query
        if oracle:
            ORACLE[f.__name__] = oracle
        return query

    return wrap

"""Registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.plans.relations import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, recursive: bool = False) -> Callable:
    """Registers a query; ``sql`` goes on from the oracle's relations in ``BASE`` (more CTEs or a SELECT)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql is not None:
            sep = "" if sql.lstrip().startswith(",") else "\n"
            base = BASE.replace("WITH", "WITH RECURSIVE", 1) if recursive else BASE
            ORACLES[key] = base.rstrip() + sep + sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.plans import all_queries  # noqa: F401

    return QUERIES["flagship_tstv_by_contig"](spark, sf_dir)

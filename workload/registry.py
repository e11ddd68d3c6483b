"""Where queries are collected together with their check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.bindings import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``build(corpus)`` under ``name``; ``check`` is the DuckDB SQL for it."""
    def add(build: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Corpus(spark, folder))
        if check:
            CHECKS[name] = check
        return build

    return add

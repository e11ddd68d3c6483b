"""Largest and important files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from srcframe.constants import IMPORTANT_RULES, NON_SOURCE_SUFFIXES
from srcframe.operators.ordering import running_total, top_per_group
from srcframe.session import broadcast_if_small


def merged_rules(custom: Mapping[str, Iterable[str]] | None = None) -> dict[str, list[str]]:
    """The built-in rules and ``custom`` ones (kind to values), in lower case."""
    custom = custom or {}
    return {
        kind: list(dict.fromkeys([*values, *(str(v).lower() for v in custom.get(kind, ()))]))
        for kind, values in IMPORTANT_RULES.items()
    }


def rule_table(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """(kind, value): built-in rules and the rows of ``custom``, without repeats."""
    rows = [(kind, value) for kind, values in IMPORTANT_RULES.items() for value in values]
    table = spark.createDataFrame(rows, "kind string, value string")
    if custom is None:
        return table
    return table.union(custom.select("kind", F.lower("value").alias("value"))).distinct()


def important_flag(
    name: Column, suffix: Column, custom: Mapping[str, Iterable[str]] | None = None
) -> Column:
    rules = merged_rules(custom)
    lowered = F.lower(name)
    tests = [lowered.isin(*rules["name"]), suffix.isin(*rules["suffix"])]
    tests += [lowered.contains(part) for part in rules["substring"]]
    return reduce(lambda a, b: a | b, tests)


def important_files(
    files: DataFrame, custom: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    """(repo, path) of important files; paths are unique in ``files``."""
    hit = important_flag(F.col("name"), F.col("suffix"), custom)
    return files.where(hit).select("repo", "path")


def important_files_by_repo(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Like :func:`important_files` with rules per repository: (repo, kind, value)."""
    def values(kind):
        return F.collect_set(F.when(F.col("kind") == kind, F.lower("value"))).alias(f"_{kind}")

    packed = rules.groupBy("repo").agg(values("name"), values("suffix"), values("substring"))
    lowered = F.lower("name")
    hit = (
        F.array_contains("_name", lowered)
        | F.array_contains("_suffix", F.col("suffix"))
        | F.exists("_substring", lambda part: F.contains(lowered, part))
    )
    joined = files.select("repo", "path", "name", "suffix").join(broadcast_if_small(packed), "repo")
    return joined.where(hit).select("repo", "path")


def important_lists(important: DataFrame) -> DataFrame:
    """(repo, path, ordinal): the sorted list of each repository as numbered rows."""
    ranked = running_total(important, ["repo"], ["path"], F.lit(1), "_before")
    return ranked.select("repo", "path", (F.col("_before") + 1).alias("ordinal"))


def largest_files(files: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest source files per repository; ties keep walk order."""
    source = files.where(~F.col("suffix").isin(*NON_SOURCE_SUFFIXES)).select(
        "repo", "path", "size_bytes", "walk_key",
        F.when(F.col("is_lfs_pointer"), F.lit(True)).alias("is_lfs"),
    )
    order = [F.desc("size_bytes"), F.asc("walk_key")]
    return top_per_group(source, ["repo"], order, n, "rank").select(
        "repo", "rank", "path", "size_bytes", "is_lfs"
    )

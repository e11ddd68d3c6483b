"""Function and file metrics of Python texts. Each text is parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.functions.python_code import python_metrics
from srcframe.operators.ordering import top_per_group


def python_only(content: Column, suffix: Column) -> Column:
    """The text of Python files, null for all others."""
    return F.when(suffix == ".py", content)


def parsed_files(files: DataFrame) -> DataFrame:
    """(repo, path, walk_key, parsed) of the Python files that parse."""
    return (
        files.where(F.col("suffix") == ".py")
        .select("repo", "path", "walk_key", python_metrics("content").alias("parsed"))
        .where(F.col("parsed").isNotNull())
    )


def function_metrics(parsed: DataFrame) -> DataFrame:
    """One row per function outside classes and other functions."""
    return parsed.select("repo", "path", "walk_key", F.inline("parsed.functions"))


def total_complexity(functions: Column) -> Column:
    return F.aggregate(
        functions, F.lit(0).cast("bigint"), lambda acc, f: acc + f["complexity_score"]
    )


def file_metrics(parsed: DataFrame) -> DataFrame:
    functions = F.col("parsed.functions")
    count, total = F.size(functions).cast("bigint"), total_complexity(functions)
    return parsed.select(
        "repo", "path",
        count.alias("function_count"),
        total.alias("total_complexity"),
        F.when(count > 0, total / count).otherwise(F.lit(0.0)).alias("average_complexity"),
        F.col("parsed.halstead_volume").alias("halstead_volume"),
        F.col("parsed.halstead_effort").alias("halstead_effort"),
    )


def repo_complexity(metrics: DataFrame) -> DataFrame:
    """Functions per repository and their mean score to two places, 0 without functions."""
    sums = metrics.groupBy("repo").agg(
        F.sum("function_count").alias("total_functions_found"),
        F.sum("total_complexity").alias("_total"),
    )
    mean = F.round(F.col("_total") / F.col("total_functions_found"), 2)
    return sums.select(
        "repo", "total_functions_found",
        F.when(F.col("total_functions_found") > 0, mean).otherwise(F.lit(0.0))
        .alias("average_cyclomatic_complexity"),
    )


def top_complex_functions(functions: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest scores per repository; ties keep walk order, then text order."""
    order = [F.desc("complexity_score"), F.asc("walk_key"), F.asc("ord")]
    return top_per_group(functions, ["repo"], order, n, "rank").select(
        "repo", "rank", F.col("path").alias("file_path"), "function_name", "line_number",
        "complexity_score",
    )

"""One report per repository, from the sections the other operators compute."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.constants import REPORT_VERSION, TIMESTAMP_FORMAT
from srcframe.operators.pieces import one_each, placed, separated


class Sections(NamedTuple):
    """A report: one bounded record per repository, and its lists of any length as rows."""

    records: DataFrame  # (repo, report)
    tree: DataFrame  # pieces (repo, key, text)
    important: DataFrame  # (repo, path)
    secrets: DataFrame  # (repo, file_path, secret_type, line_number, line_content)


def _listed(df: DataFrame, out: str, order: list[str], fields: list[str]) -> DataFrame:
    """The first rows of each repository, a fixed number, as one ordered array of structs."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    picked = F.transform(ordered, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return df.groupBy("repo").agg(picked.alias(out))


def assemble_report(
    totals: DataFrame,
    primary: DataFrame,
    languages: DataFrame,
    complexity: DataFrame,
    markers: DataFrame,
    top_functions: DataFrame,
    largest: DataFrame,
    dependency_map: DataFrame,
    repos: DataFrame | None = None,
    duration_seconds: float = 0.0,
    now: Column | None = None,
) -> DataFrame:
    """(repo, report) with one nested record per repository.

    Every section is one row per repository before it is joined, and bounded: sums, lists
    cut to their first rows, names in root manifests. ``repos`` adds repositories without
    any file.
    """
    if repos is not None:
        totals = repos.select("repo").distinct().join(totals, "repo", "left").na.fill(0)
    by_language = F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "code"))))
    joined = (
        totals.join(primary, "repo", "left")
        .join(languages.groupBy("repo").agg(by_language.alias("language_stats")), "repo", "left")
        .join(complexity, "repo", "left")
        .join(markers, "repo", "left")
        .join(_listed(top_functions, "top_functions", ["rank"],
                      ["file_path", "function_name", "line_number", "complexity_score"]), "repo", "left")
        .join(_listed(largest, "largest", ["rank"], ["path", "size_bytes", "is_lfs"]), "repo", "left")
        .join(dependency_map, "repo", "left")
    )

    def listed(name):
        return F.coalesce(name, F.array().cast(joined.schema[name].dataType))

    def mapped(name):
        return F.coalesce(name, F.create_map().cast(joined.schema[name].dataType))

    def count(name):
        return F.coalesce(name, F.lit(0).cast("bigint")).alias(name)

    stamp = F.current_timestamp() if now is None else now
    return joined.select("repo", F.struct(
        F.struct(
            F.lit(REPORT_VERSION).alias("report_version"),
            F.date_format(stamp, TIMESTAMP_FORMAT).alias("timestamp"),
            F.lit(float(duration_seconds)).alias("analysis_duration_seconds"),
        ).alias("analysis_metadata"),
        F.struct(
            "total_files", "total_lines_of_code", "primary_language",
            mapped("language_stats").alias("language_stats"),
            count("total_functions_found"),
            F.coalesce("average_cyclomatic_complexity", F.lit(0.0)).alias("average_cyclomatic_complexity"),
        ).alias("repository_summary"),
        F.struct(listed("largest").alias("largest_files")).alias("key_files"),
        F.struct(
            count("todo_count"), count("fixme_count"),
            listed("top_functions").alias("top_complex_functions"),
        ).alias("code_insights"),
        F.struct(mapped("dependency_files_found").alias("dependency_files_found")).alias("dependency_info"),
    ).alias("report"))


def report_json(sections: Sections) -> DataFrame:
    """(repo, key, text): the JSON document of each repository, as ordered pieces."""
    def inner(*names):
        text = F.to_json(F.struct(*[F.col(f"report.{n}") for n in names]), {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(2), F.length(text) - 2)

    def entry(*fields):
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    records = sections.records
    files = F.concat(F.lit(',"key_files":{'), F.regexp_extract(inner("key_files"), r'(?s)^"key_files":\{(.*)\}$', 1))
    name = entry(F.col("path").alias("p"))
    important = sections.important.select(
        "repo", F.col("path").alias("key"), F.regexp_extract(name, r'(?s)^\{"p":(.*)\}$', 1).alias("text"))
    line = F.lpad(F.col("line_number").cast("string"), 12, "0")
    secrets = sections.secrets.select(
        "repo", F.concat_ws("\u0000", "file_path", line, "secret_type").alias("key"),
        entry("file_path", "secret_type", "line_number", "line_content").alias("text"))
    parts = (
        one_each(records, "a", F.concat(
            F.lit("{"), inner("analysis_metadata", "repository_summary"), F.lit(',"directory_tree":'))),
        placed(sections.tree, "b"),
        one_each(records, "c", F.concat(files, F.lit(',"important_files_detected":['))),
        placed(separated(important), "d"),
        one_each(records, "e", F.concat(
            F.lit("]},"), inner("code_insights", "dependency_info"), F.lit(',"threat_assessment":{"secrets_found":['))),
        placed(separated(secrets), "f"),
        one_each(records, "g", F.lit("]}}")),
    )
    document = parts[0]
    for part in parts[1:]:
        document = document.unionByName(part)
    return document

"""Line statistics per file, and their sums per language and repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.functions import lines


def file_languages(files: DataFrame) -> DataFrame:
    """Files of a known language, with that language."""
    return files.withColumn("language", lines.language_of(F.col("path"))).where(
        F.col("language").isNotNull()
    )


def file_stats(files: DataFrame, *extra: Column, unknown: bool = False) -> DataFrame:
    """One row per file of a known language: line classes and the hash of its text.

    With ``unknown`` the other files have a row too, without classes.

    ``extra`` columns are computed from ``files`` in the same pass.
    """
    text = F.col("content")
    spoken = files.withColumn("language", lines.language_of(F.col("path"))) if unknown else file_languages(files)
    has = F.col("language").isNotNull()
    known = spoken.select(
        "repo", "path", "walk_key", "language",
        F.when(has, lines.line_count(text)).alias("_lines"),
        F.when(has, lines.blank_count(text)).alias("blank"),
        F.when(has, lines.comment_count(text, F.col("language"))).alias("comment"),
        # a hash that the files bring is not made again
        F.col("content_hash") if "content_hash" in files.columns else lines.content_hash(text).alias("content_hash"),
        *extra,
    )
    code = F.col("_lines") - F.col("blank") - F.col("comment")
    return known.withColumn("code", code).drop("_lines")


def language_lines(stats: DataFrame) -> DataFrame:
    """Code lines per repository and language; languages without code lines stay."""
    return stats.groupBy("repo", "language").agg(F.sum("code").alias("code"))


def repo_totals(files: DataFrame, stats: DataFrame) -> DataFrame:
    """File count (of any type) and code lines per repository."""
    counts = files.groupBy("repo").agg(F.count("*").alias("total_files"))
    loc = stats.groupBy("repo").agg(F.sum("code").alias("total_lines_of_code"))
    return counts.join(loc, "repo", "left").select(
        "repo", "total_files",
        F.coalesce("total_lines_of_code", F.lit(0).cast("bigint")).alias("total_lines_of_code"),
    )


def primary_language(stats: DataFrame) -> DataFrame:
    """Language with most code lines; on a tie the one first met in walk order."""
    sums = stats.groupBy("repo", "language").agg(
        F.sum("code").alias("code"), F.min("walk_key").alias("first_key")
    )
    return sums.groupBy("repo").agg(
        F.min_by("language", F.struct(-F.col("code"), "first_key")).alias("primary_language")
    )


def marker_counts(files: DataFrame) -> DataFrame:
    """TODO and FIXME marks per file, for files of any type."""
    text = F.col("content")
    return files.select(
        "repo", "path",
        lines.marker_count(text, "TODO").alias("todo_count"),
        lines.marker_count(text, "FIXME").alias("fixme_count"),
    )


def marker_totals(counts: DataFrame) -> DataFrame:
    """Marks per repository, from the counts per file."""
    return counts.groupBy("repo").agg(
        F.coalesce(F.sum("todo_count"), F.lit(0)).alias("todo_count"),
        F.coalesce(F.sum("fixme_count"), F.lit(0)).alias("fixme_count"),
    )

"""Per-repository options: stored defaults and overrides of one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from srcframe.functions import paths
from srcframe.functions.globs import shell_regex
from srcframe.functions.lines import strip
from srcframe.operators.membership import drop_members
from srcframe.session import broadcast_if_small, fits_broadcast, materialize


def split_comma_list(raw: Column) -> Column:
    """``'a, b,,c'`` -> ``[a, b, c]``; null stays null and '' gives an empty list."""
    items = F.transform(F.split(raw, ","), strip)
    return F.filter(items, lambda x: x != "")


def merge_exclusions(
    config: DataFrame, dirs: str | None = None, patterns: str | None = None
) -> DataFrame:
    """(repo, exclude_dirs, exclude_patterns): an override wins whenever it was given."""
    def pick(name, given):
        override = split_comma_list(F.lit(given).cast("string"))
        return F.coalesce(override, F.col(name)).alias(name)

    return config.select("repo", pick("exclude_dirs", dirs), pick("exclude_patterns", patterns))


def merge_options(config: DataFrame, overrides: dict) -> DataFrame:
    """Set option columns of ``config`` to every override that was given: None, '', 0 and False were not."""
    given = {k: F.lit(v) for k, v in overrides.items() if v}
    return config.withColumns(given) if given else config


@pandas_udf(StringType())
def _any_glob_regex(globs):
    return globs.map(lambda gs: "|".join(f"(?:{shell_regex(g)})" for g in gs) if gs is not None and len(gs) else None)


def apply_exclusions(files: DataFrame, options: DataFrame) -> DataFrame:
    """Drop files by the directories and name globs of their own repository."""
    small = options.select(
        "repo", "exclude_dirs", _any_glob_regex("exclude_patterns").alias("_globs")
    )
    by_dir = F.arrays_overlap(paths.dir_parts(F.col("path")), F.col("exclude_dirs"))
    by_name = F.regexp_instr(F.col("name"), F.col("_globs")) > 0
    excluded = F.coalesce(by_dir, F.lit(False)) | F.coalesce(by_name, F.lit(False))
    small = materialize(small)
    if fits_broadcast(small):
        return files.join(F.broadcast(small), "repo", "left").where(~excluded).select(*files.columns)
    return drop_members(files, excluded_files(files, options), ["repo", "path"])


def excluded_files(files: DataFrame, options: DataFrame) -> DataFrame:
    """(repo, path) of the files that their repository's options exclude, found with narrow keys.

    A directory meets the exclusions by (repository, name of a directory), so no list of
    names is searched; a file's name meets the globs of its repository.
    """
    keys = files.select("repo", "path", "name")
    names = options.select("repo", F.explode("exclude_dirs").alias("dir")).distinct()
    folders = files.select("repo", paths.parent_dir(F.col("path")).alias("parent")).distinct()
    parts = folders.select("repo", "parent", F.explode(F.array_distinct(F.split("parent", "/"))).alias("dir"))
    gone = parts.join(names, ["repo", "dir"], "left_semi").select("repo", "parent").distinct()
    below = keys.withColumn("parent", paths.parent_dir(F.col("path"))).join(gone, ["repo", "parent"], "left_semi")
    globs = options.select("repo", _any_glob_regex("exclude_patterns").alias("_globs")).where(F.col("_globs").isNotNull())
    named = keys.join(broadcast_if_small(materialize(globs)), "repo").where(F.regexp_instr(F.col("name"), F.col("_globs")) > 0)
    return below.select("repo", "path").unionByName(named.select("repo", "path")).distinct()

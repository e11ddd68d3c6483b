"""Row filters on the files table. None of them shuffles, but for the file-count guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.constants import (
    BINARY_SUFFIXES, DEFAULT_IGNORED_DIRS, GENERATED_MARKER, MAX_FILES_PER_REPO,
    PACK_MAX_FILE_KB, SOURCE_SUFFIXES,
)
from srcframe.functions.globs import any_shell_match, quote
from srcframe.functions.lines import first_line
from srcframe.session import broadcast_if_small, compute_once


def _below_any(names: Sequence[str]) -> Column:
    """A directory on the path has one of the names; one literal regex, no arrays."""
    quoted = "|".join(quote(n) for n in names)
    return F.col("path").rlike(rf"(?:^|/)(?:{quoted})/")


def exclude_dirs(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop files below a directory with one of the exact names, at any depth."""
    return files.where(~_below_any(names)) if names else files


def drop_default_dirs(files: DataFrame) -> DataFrame:
    return exclude_dirs(files, DEFAULT_IGNORED_DIRS)


def drop_hidden(files: DataFrame) -> DataFrame:
    """Drop files whose name, or a directory on their path, starts with a dot."""
    return files.where(~(F.col("path").startswith(".") | F.col("path").contains("/.")))


def exclude_patterns(files: DataFrame, globs: Sequence[str]) -> DataFrame:
    """Drop files whose name matches one of the shell globs."""
    return files.where(~any_shell_match(F.col("name"), list(globs))) if globs else files


def drop_symlinks(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_symlink"))


def normal_suffixes(extra: Sequence[str]) -> list[str]:
    """User suffixes in lower case, each with its dot."""
    cleaned = [e.strip().lower() for e in extra if e.strip()]
    return [e if e.startswith(".") else f".{e}" for e in cleaned]


def drop_binary_suffixes(files: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return files.where(~F.col("suffix").isin(*BINARY_SUFFIXES, *normal_suffixes(extra)))


def keep_source_suffixes(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(*SOURCE_SUFFIXES))


def keep_size_band(files: DataFrame, max_kb: int | None = PACK_MAX_FILE_KB) -> DataFrame:
    """Files with bytes on disk, and no more than ``max_kb`` of them; None sets no limit."""
    kept = files.where(F.col("disk_size") > 0)
    return kept if max_kb is None else kept.where(F.col("disk_size") <= max_kb * 1024)


def drop_nul_texts(files: DataFrame) -> DataFrame:
    return files.where(~F.col("content").contains("\u0000"))


def drop_generated(
    files: DataFrame, where: str = "start", marker: str = GENERATED_MARKER
) -> DataFrame:
    """Drop texts this package wrote: marker at the ``start``, or in the ``first_line``."""
    text = F.col("content")
    if where == "start":
        return files.where(~text.startswith(marker))
    if where == "first_line":
        return files.where(~first_line(text).contains(marker))
    raise ValueError(f"unknown place: {where}")


def keep_plain_texts(files: DataFrame, where: str, marker: str = GENERATED_MARKER) -> DataFrame:
    """Drop texts with NUL and texts this package wrote, in one look at each text."""
    text = F.col("content")
    written = text.startswith(marker) if where == "start" else first_line(text).contains(marker)
    flagged = compute_once(files, _plain=~text.contains("\u0000") & ~written)
    return flagged.where("_plain").drop("_plain")


def drop_paths(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Drop the (repo, path) rows of ``outputs``: a job's own results are not its input."""
    return files.join(
        broadcast_if_small(outputs.select("repo", "path")), ["repo", "path"], "left_anti"
    )


def oversized_repos(files: DataFrame, max_files: int = MAX_FILES_PER_REPO) -> DataFrame:
    """(repo, file_count) of repositories above the limit."""
    return files.groupBy("repo").agg(F.count("*").alias("file_count")).where(
        F.col("file_count") > max_files
    )


def guard_max_files(files: DataFrame, max_files: int = MAX_FILES_PER_REPO) -> DataFrame:
    """Stop when a repository is above the file limit."""
    worst = oversized_repos(files, max_files).orderBy(F.desc("file_count"), "repo").first()
    if worst:
        raise ValueError(f"repository {worst.repo} has {worst.file_count} files, more than {max_files}")
    return files


def repos_within(files: DataFrame, max_files: int) -> DataFrame:
    """Files of the repositories that :func:`guard_max_files` lets pass."""
    return files.join(oversized_repos(files, max_files).select("repo"), "repo", "left_anti")

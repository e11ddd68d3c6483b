"""The ``files`` table built from any table that holds texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.functions import lines, paths

FILE_COLUMNS = (
    "repo", "path", "name", "suffix", "disk_size", "content", "is_symlink",
    "is_lfs_pointer", "real_size", "size_bytes", "walk_key",
)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def files_from_table(
    df: DataFrame,
    repo: str | Column = "repo",
    path: str | Column = "path",
    content: str | Column = "content",
    disk_size: str | Column | None = None,
    is_symlink: str | Column | None = None,
) -> DataFrame:
    """Bind a table of texts to the files contract.

    ``disk_size`` defaults to the byte length of the text as it is in the table. All
    columns are plain projections, so a job that never reads ``content`` prunes it.
    """
    raw = _col(content)
    size = _col(disk_size) if disk_size is not None else F.octet_length(raw)
    base = df.select(
        _col(repo).alias("repo"),
        _col(path).alias("path"),
        size.cast("bigint").alias("disk_size"),
        lines.unify_newlines(raw).alias("content"),
        (_col(is_symlink) if is_symlink is not None else F.lit(False)).alias("is_symlink"),
    )
    path_ = F.col("path")
    return base.select(
        "repo", "path",
        paths.file_name(path_).alias("name"),
        paths.suffix(path_).alias("suffix"),
        "disk_size", "content", "is_symlink",
        F.lit(False).alias("is_lfs_pointer"),
        F.lit(None).cast("bigint").alias("real_size"),
        F.col("disk_size").alias("size_bytes"),
        paths.walk_key(path_).alias("walk_key"),
    )

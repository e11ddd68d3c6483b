"""Directory sizes, the node table, and nested tree documents as ordered pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from srcframe.functions import paths
from srcframe.operators.pieces import one_each, separated

_LEAF = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("is_lfs_pointer", T.BooleanType()),
    T.StructField("real_size", T.LongType()),
])


def directory_sizes(files: DataFrame) -> DataFrame:
    """(repo, dir, size_bytes): every directory with the sizes of all files below it.

    Files are summed per own directory first, so only distinct directories are
    expanded into their ancestors.
    """
    direct = files.groupBy("repo", paths.parent_dir(F.col("path")).alias("dir")).agg(
        F.sum("size_bytes").alias("size_bytes")
    )
    return (
        direct.select("repo", F.explode(paths.ancestors(F.col("dir"))).alias("dir"), "size_bytes")
        .groupBy("repo", "dir").agg(F.sum("size_bytes").alias("size_bytes"))
    )


def tree_nodes(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """The tree as rows: one per file and directory, in no order.

    ``dirs`` (repo, path) adds directories that hold no file.
    """
    sized = directory_sizes(files)
    if dirs is not None:
        empty = dirs.select("repo", F.col("path").alias("dir"), F.lit(0).cast("bigint").alias("size_bytes"))
        sized = sized.unionByName(empty).groupBy("repo", "dir").agg(F.sum("size_bytes").alias("size_bytes"))
    path = F.col("path")
    file_rows = files.select(
        "repo", "path", F.lit("file").alias("type"), "size_bytes",
        "is_lfs_pointer", "real_size", "walk_key",
    )
    dir_rows = sized.select(
        "repo", F.col("dir").alias("path"), F.lit("directory").alias("type"), "size_bytes",
        F.lit(False).alias("is_lfs_pointer"), F.lit(None).cast("bigint").alias("real_size"),
        paths.dir_walk_key(F.col("dir")).alias("walk_key"),
    )
    return file_rows.unionByName(dir_rows).select(
        "repo", "path", paths.parent_dir(path).alias("parent_path"),
        paths.file_name(path).alias("name"), "type", paths.depth(path).alias("depth"),
        "size_bytes", "is_lfs_pointer", "real_size", "walk_key",
    )


def nest_tree(
    files: DataFrame, dirs: DataFrame | None = None, repos: DataFrame | None = None
) -> DataFrame:
    """(repo, key, text): the nested JSON document of each repository, as ordered pieces.

    In walk order the document is a plain sequence: every directory opens, its contents
    follow, and it closes. So each node gives its own pieces, and no row or task holds a
    whole document. ``repos`` adds repositories without any node.
    """
    nodes = tree_nodes(files, dirs)
    keep_nulls = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct("name", "type", "size_bytes"), keep_nulls)
    tail = F.to_json(F.struct("is_lfs_pointer", "real_size"), keep_nulls)
    head_open = F.substring(head, F.lit(1), F.length(head) - 1)
    tail_rest = F.substring(tail, F.lit(2), F.length(tail))
    is_dir = F.col("type") == "directory"
    opened = F.when(is_dir, F.concat(head_open, F.lit(',"children":['))).otherwise(
        F.concat(head_open, F.lit(',"children":null,'), tail_rest))
    entries = separated(
        nodes.select("repo", "parent_path", F.col("walk_key").alias("key"), opened.alias("text")), ("parent_path",)
    )
    # '2' sorts after every child, which start with '0' or '1'.
    closed = nodes.where(is_dir).select(
        "repo", F.concat("walk_key", F.lit("2")).alias("key"), F.concat(F.lit("],"), tail_rest).alias("text")
    )
    known = files.select("repo") if repos is None else repos.select("repo")
    if dirs is not None:
        known = known.union(dirs.select("repo"))
    known = known.distinct()
    return (
        one_each(known, "", F.lit("[")).unionByName(entries).unionByName(closed)
        .unionByName(one_each(known, "3", F.lit("]")))
    )


def flatten_tree(pieces: DataFrame) -> DataFrame:
    """The files in a document made by :func:`nest_tree`, in one pass over its pieces.

    A file's piece holds its facts, and its key the directories it is in.
    """
    leaves = pieces.where(F.col("key").rlike("(?:^|\u0000)1[^\u0000]*$"))
    path = F.regexp_replace(F.replace("key", F.lit("\u0000"), F.lit("/")), "(^|/)[01]", "$1")
    fact = F.from_json(F.regexp_replace("text", "^,", ""), _LEAF)
    return leaves.select("repo", path.alias("path"), fact.alias("f")).select(
        "repo", "path", "f.type", "f.size_bytes", "f.is_lfs_pointer", "f.real_size"
    )

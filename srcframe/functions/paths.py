"""Names, suffixes and order keys of slash-separated paths."""

from pyspark.sql import Column, functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part without a trailing slash; '' for files at the root."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def dir_parts(path: Column) -> Column:
    """Names of all directories above the file, outermost first."""
    return F.filter(F.split(parent_dir(path), "/"), lambda d: d != "")


def suffix(path: Column) -> Column:
    """Lower-case suffix of the name; '' when its last dot is its first or last character."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def walk_key(path: Column) -> Column:
    """A string whose byte order is the walk order: directories first, then files.

    Each directory becomes ``0name`` and the file ``1name``; parts are joined by NUL,
    which no path can contain and which sorts before every other character.
    """
    named = F.regexp_replace(path, r"([^/]+)\z", "1$1")
    return F.regexp_replace(named, "([^/]+)/", "0$1\u0000")


def dir_walk_key(folder: Column) -> Column:
    """Order key of a directory itself: it sorts right before everything below it."""
    return F.concat(F.lit("0"), F.replace(folder, F.lit("/"), F.lit("\u00000")), F.lit("\u0000"))


def ancestors(folder: Column) -> Column:
    """``a/b/c`` -> ``[a, a/b, a/b/c]``; an empty path has none."""
    parts = F.split(folder, "/")
    chain = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.when(folder != "", chain).otherwise(F.array().cast("array<string>"))

"""Documents of any size as rows: (repo, key, text), to be joined in the order of ``key``.

No row holds more than one entry, so a document may be larger than any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def separated(items: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Put a comma before every entry but the first of its list.

    A list is a repository, or what ``within`` tells apart in it. The first entries are
    found by a sum that tasks make in part, and marked by their unique key.
    """
    first = items.groupBy("repo", *within).agg(F.min("key").alias("key")).select(
        "repo", "key", F.lit("").alias("_comma")
    )
    marked = items.join(first, ["repo", "key"], "left")
    text = F.concat(F.coalesce("_comma", F.lit(",")), "text")
    return marked.select("repo", "key", text.alias("text"))


def placed(pieces: DataFrame, section: str) -> DataFrame:
    """Put all pieces into one section of a larger document."""
    return pieces.select("repo", F.concat(F.lit(section), "key").alias("key"), "text")


def one_each(repos: DataFrame, section: str, text: Column) -> DataFrame:
    """One piece per repository."""
    return repos.select("repo", F.lit(section).alias("key"), text.alias("text"))

"""Writers. Texts that can be large are written as ordered blocks, one per file.

Blocks are dealt to tasks by bounds between their keys, so a large repository is written by
many tasks. Its part files, read in name order, are the whole text. The bounds come from a
sample of narrow keys, so the plan that makes the texts runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from srcframe import __version__
from srcframe.constants import GENERATED_MARKER
from srcframe.operators.pack import format_pack

# Keys in the sample for each part; their share of all keys evens out.
SAMPLED = 100
# Rows that a part has at least, about.
LEAST_ROWS = 64


def key_bounds(keys: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` (repo, key) values that cut ``keys`` into about equal shares."""
    total = keys.count()
    parts = min(parts, total // LEAST_ROWS)
    if parts < 2:
        return []
    share = min(1.0, 2 * SAMPLED * parts / total)
    found = keys.select("repo", key).sample(share, 7).distinct().orderBy("repo", key).collect()
    cuts = {len(found) * i // parts for i in range(1, parts)}
    return [tuple(found[i]) for i in sorted(cuts) if 0 < i < len(found)]


def part_of(bounds: list, key: str, kind) -> Column:
    """How many bounds are no greater than a row's (repo, key)."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.struct(F.lit(r).alias("repo"), F.lit(k).cast(kind).alias(key)) for r, k in bounds])
    return F.size(F.filter(listed, lambda b: b <= F.struct("repo", key)))


def _write_ordered(rows: DataFrame, key: str, folder: str, keys: DataFrame | None = None) -> None:
    """Write ``value`` lines per repository in the order of ``key``.

    ``keys (repo, key)`` tells where the bounds lie without a look at the rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = key_bounds(rows.select("repo", key) if keys is None else keys.select("repo", key), key, parts)
    dealt = rows.repartitionById(len(bounds) + 1, part_of(bounds, key, rows.schema[key].dataType))
    ordered = dealt.sortWithinPartitions("repo", key)
    ordered.select("repo", "value").write.partitionBy("repo").mode("overwrite").text(folder)


def write_report(pieces: DataFrame, folder: str) -> None:
    """The JSON document of each repository below ``repo=<name>``, from (repo, key, text).

    Pieces are whole tokens, so the line breaks between them do not change the document.
    """
    _write_ordered(pieces.withColumnRenamed("text", "value"), "key", folder)


def write_pack(
    texts: DataFrame, folder: str, fmt: str = "raw", marker: str = GENERATED_MARKER, keys: DataFrame | None = None
) -> None:
    """The chosen texts of each repository, as blocks or as one JSON document.

    ``keys``, such as the choice itself, has the (repo, pick_order) of ``texts``.
    """
    order = None if keys is None else keys.select(
        "repo", F.concat(F.lit("1"), F.lpad(F.col("pick_order").cast("string"), 12, "0")).alias("key"))
    if keys is None:
        pieces = format_pack(texts, fmt, marker=marker)
    else:  # the pieces around the files need no text either
        files = format_pack(texts, fmt, marker=marker).where("substr(key, 1, 1) = '1'")
        bare = keys.select("repo", "pick_order", F.lit("").alias("path"), F.lit("").alias("content"))
        pieces = files.unionByName(format_pack(bare, fmt, marker=marker).where("substr(key, 1, 1) <> '1'"))
    _write_ordered(pieces.withColumnRenamed("text", "value"), "key", folder, order)


def write_distilled(
    blocks: DataFrame, folder: str, marker: str = GENERATED_MARKER, keys: DataFrame | None = None
) -> None:
    """The shortened texts of each repository, after the marker and an empty line.

    ``keys (repo, walk_key)`` lists what was to be shortened; with it each text is made once, and
    a repository of which nothing was left has the marker alone.
    """
    places = blocks.select("repo", "walk_key") if keys is None else keys.select("repo", "walk_key")
    first = places.select("repo").distinct().select(
        "repo", F.lit(None).cast("string").alias("walk_key"), F.lit(f"{marker}\n").alias("value"))
    rows = blocks.select("repo", "walk_key", F.col("block").alias("value")).unionByName(first)
    _write_ordered(rows, "walk_key", folder, places)


def distill_map(ranges: DataFrame, level: int, root: str = "") -> DataFrame:
    """(repo, walk_key, value): JSON of every mapping, with the run's own facts in each."""
    return ranges.select("repo", "walk_key", F.to_json(F.struct(
        F.lit(__version__).alias("version"),
        F.lit(level).alias("distillation_level"),
        F.concat(F.lit(root), "repo").alias("source_root"),
        F.array("first_line", "last_line").alias("distilled_range"),
        F.array("output_first_line", "output_last_line").alias("output_range"),
        F.col("path").alias("source_file"),
    )).alias("value"))


def write_distill_map(ranges: DataFrame, folder: str, level: int, root: str = "") -> None:
    _write_ordered(distill_map(ranges, level, root), "walk_key", folder)

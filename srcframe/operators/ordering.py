"""Ordered computations that hold when one repository owns a third of all rows.

A window over a repository would put all its rows into one task. Here rows are first
range-partitioned by the full sort key, so a large repository spreads over many slices;
a running total is the total of the earlier slices plus the running total in the slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcframe.session import broadcast_if_small, materialize

RANK_LOTS = 256


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    costly_input: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    ``group + order`` must be unique. Set ``costly_input`` when ``df`` is expensive to
    compute: range partitioning samples its input, which would compute it twice.
    """
    narrow = df.withColumn("_value", value)
    if costly_input:
        narrow = materialize(narrow)
    # Slices are stored, so that both reads below see the same cut.
    sliced = materialize(
        narrow.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    )
    by_slice = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = (
        sliced.groupBy(*group, "_slice").agg(F.sum("_value").alias("_sum"))
        .withColumn("_earlier", F.coalesce(F.sum("_sum").over(by_slice), F.lit(0)))
        .drop("_sum")
    )
    within = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        sliced.join(broadcast_if_small(earlier), [*group, "_slice"])
        .withColumn(
            out,
            (F.col("_earlier") + F.coalesce(F.sum("_value").over(within), F.lit(0))).cast("bigint"),
        )
        .drop("_value", "_slice", "_earlier")
    )


def walk_order(files: DataFrame) -> DataFrame:
    """(repo, path, ordinal): the 1-based place of every file in walk order."""
    ranked = running_total(
        files.select("repo", "path", "walk_key"), ["repo"], ["walk_key"], F.lit(1), "_before"
    )
    return ranked.select("repo", "path", (F.col("_before") + 1).alias("ordinal"))


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str
) -> DataFrame:
    """First ``n`` rows of each group.

    Spark cuts each task's rows to ``n`` per group before a shuffle. A group with rows in
    very many tasks still brings ``n`` from each, so tasks are first ranked in lots and
    the final window gets no more than ``n`` rows per lot.
    """
    lots = df.withColumn("_lot", F.pmod(F.spark_partition_id(), F.lit(RANK_LOTS)))
    for keys in ([*group, "_lot"], group):
        window = Window.partitionBy(*keys).orderBy(*order)
        lots = lots.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= max(0, n))
    return lots.drop("_lot")

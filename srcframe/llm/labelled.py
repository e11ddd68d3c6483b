"""The bounded labelled sample that the two trained operators fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(key: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves ``rest``; a null key counts as held out."""
    crc = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    return F.coalesce(crc % modulus == rest, F.lit(True))


def known_labels(labels: DataFrame, label: str, held: Column) -> DataFrame:
    """``doc_id`` and ``_label`` outside the held-out part; of repeated labels the larger counts."""
    return labels.where(~held & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, held: Column, per_class: int, text: str = "text") -> DataFrame:
    """``_label`` and ``_text`` of at most ``per_class`` documents of each label.

    The choice is by hash of the key, over all labelled rows outside the held-out part.
    Only the chosen keys are broadcast: ``2 * per_class`` of them at most.
    """
    known = known_labels(labels, label, held)
    parts = [known.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("_label", "_text")

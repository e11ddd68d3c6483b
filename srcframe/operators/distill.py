"""Shortened texts: comments and bodies removed, and the line ranges of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcframe.constants import (
    DISTILL_FOOTER_LINES, DISTILL_HEADER_LINES, DISTILL_RULE, GENERATED_MARKER,
)
from srcframe.functions.lines import distill_text, line_count
from srcframe.functions.tokens import joined_token_count
from srcframe.functions.python_code import python_skeleton, python_skeleton_plain
from srcframe.operators import filters
from srcframe.operators.ordering import running_total
from srcframe.operators.pymetrics import python_only
from srcframe.session import compute_once

# The marker and an empty line stand before the first block.
PREAMBLE_LINES = 2


def distill_inputs(
    files: DataFrame, outputs: DataFrame | None = None, marker: str = GENERATED_MARKER
) -> DataFrame:
    """Source texts to shorten. Tests that need no text come first."""
    kept = filters.keep_source_suffixes(filters.drop_symlinks(files))
    if outputs is not None:
        kept = filters.drop_paths(kept, outputs)
    return filters.keep_plain_texts(kept, "first_line", marker)


def distilled(inputs: DataFrame, level: int = 2, anchors: bool = True) -> DataFrame:
    """(repo, path, walk_key, distilled); texts that become empty are left out.

    Level 1 strips comments, level 2 also empties Python function bodies. Python texts
    that do not parse get level 1.
    """
    if level not in (1, 2):
        raise ValueError(f"unknown level: {level}")
    text = F.col("content")
    if level == 1:
        out = compute_once(inputs, distilled=distill_text(text))
    else:
        hollow = python_skeleton if anchors else python_skeleton_plain
        parsed = inputs.withColumn("_skeleton", hollow(python_only(text, F.col("suffix"))))
        out = compute_once(parsed, distilled=F.coalesce("_skeleton", distill_text(text)))
    return out.where(F.col("distilled") != "").select("repo", "path", "walk_key", "distilled")


def line_ranges(texts: DataFrame) -> DataFrame:
    """(repo, path, first_line, last_line, output_first_line, output_last_line).

    The first pair counts from the first block, the second from the top of the written
    text. Only paths and line counts are ordered, never the texts.
    """
    sized = texts.select("repo", "path", "walk_key", line_count(F.col("distilled")).alias("lines"))
    ranged = running_total(
        sized, ["repo"], ["walk_key"],
        F.col("lines") + DISTILL_HEADER_LINES + DISTILL_FOOTER_LINES, "_before", costly_input=True,
    )
    first = F.col("_before") + DISTILL_HEADER_LINES + 1
    last = first + F.col("lines") - 1
    return ranged.select(
        "repo", "path", "walk_key",
        first.alias("first_line"), last.alias("last_line"),
        (first + PREAMBLE_LINES).alias("output_first_line"),
        (last + PREAMBLE_LINES).alias("output_last_line"),
    )


def distill_stats(blocks: DataFrame, method="pieces", marker: str = GENERATED_MARKER) -> DataFrame:
    """(repo, files_processed, total_tokens) of the written texts.

    Blocks are counted where they are, so no text of a whole repository is built.
    """
    return blocks.groupBy("repo").agg(
        F.count("*").alias("files_processed"),
        joined_token_count(F.col("block"), method, marker, 1).alias("total_tokens"),
    )


def distilled_blocks(texts: DataFrame) -> DataFrame:
    """(repo, walk_key, block): what is written for each file; one line break joins blocks."""
    block = F.concat(
        F.lit(f"{DISTILL_RULE}\n--- FILE: "), "path", F.lit(f" ---\n{DISTILL_RULE}\n"),
        "distilled", F.lit("\n\n"),
    )
    return texts.select("repo", "path", "walk_key", block.alias("block"))

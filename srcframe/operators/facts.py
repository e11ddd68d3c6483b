"""Everything the report needs to know of a file, from one pass over its text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from srcframe.functions import lines
from srcframe.functions.python_code import python_metrics
from srcframe.operators.pymetrics import python_only
from srcframe.operators.secrets import DEFAULT_RULES, SecretRule, secret_hits
from srcframe.session import compute_once


def file_facts(files: DataFrame, rules: Sequence[SecretRule] = DEFAULT_RULES) -> DataFrame:
    """One narrow row per file: sizes, line classes, marks, Python metrics and secrets.

    Each text is read once and Python is parsed once. Store the result: all sections of
    a report are sums and rankings over it. Line classes are null where the language is
    not known, ``parsed`` where the text is no valid Python.
    """
    text, language = F.col("content"), F.col("language")
    known = language.isNotNull()
    # All columns of the JVM come first, so that rows wait for the Python worker without
    # their texts.
    counted = compute_once(
        files.withColumn("language", lines.language_of(F.col("path"))),
        _lines=F.when(known, lines.line_count(text)),
        blank=F.when(known, lines.blank_count(text)),
        comment=F.when(known, lines.comment_count(text, language)),
        **({} if "content_hash" in files.columns else {"content_hash": lines.content_hash(text)}),
        todo_count=lines.marker_count(text, "TODO"),
        fixme_count=lines.marker_count(text, "FIXME"),
        secrets=secret_hits(text, rules),
        _python=python_only(text, F.col("suffix")),
    )
    code = F.col("_lines") - F.col("blank") - F.col("comment")
    return counted.select(
        "repo", "path", "name", "suffix", "size_bytes", "is_lfs_pointer", "real_size", "walk_key",
        "language", code.alias("code"), "blank", "comment", "content_hash", "todo_count",
        "fixme_count", "secrets", python_metrics("_python").alias("parsed"),
    )


TEXT_FACTS = (
    "repo", "path", "content_hash", "language", "code", "blank", "comment", "todo_count", "fixme_count", "secrets", "parsed")
PLACE_FACTS = ("name", "suffix", "size_bytes", "is_lfs_pointer", "real_size", "walk_key")


def text_facts(files: DataFrame) -> DataFrame:
    """What of :func:`file_facts` depends on a path and its text alone, to be stored for later runs."""
    return file_facts(files).select(*TEXT_FACTS)


def placed_facts(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The facts of ``files`` from ``stored`` ones; only the hash is made of a text."""
    key = ["repo", "path", "content_hash"]
    places = files.select("repo", "path", *PLACE_FACTS, lines.content_hash(F.col("content")).alias("content_hash"))
    held = stored.select(*TEXT_FACTS)
    return places.join(held, key).select(
        "repo", "path", *PLACE_FACTS, *[c for c in TEXT_FACTS if c not in ("repo", "path")])

"""The corpus pipeline: from ``documents`` to token ids, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``, the
last one the digests of the encoded texts. Between stages the rows are written as Parquet
and read again, so a lost executor repeats one stage at most. Texts go to Python in small
Arrow batches, as an executor's heap has grown to its bound in earlier stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcframe.llm import decontaminate, jaccard_join, labelled, line_dedup, quality, queries
from srcframe.llm.common import batches_within, load, trim_driver, written


def _plain(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    trim_driver(spark)
    batches_within(spark)
    labels = load(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, labelled.held_out("doc_id", 5, 0))
    scored = quality.score(docs, model, keep=tuple(docs.columns))
    _, predicted = quality.result_names(docs.columns)
    return scored.where(F.col(predicted) == 1).select(*_plain(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines go; so does a document that had nothing else."""
    trim_driver(spark)
    done = line_dedup.dedup(docs)
    lines, removed = map(F.col, line_dedup.result_names(docs))
    left = done.where((removed == 0) | (removed < lines))
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*_plain(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked as near copies the one with the smallest id stays."""
    trim_driver(spark)
    return jaccard_join.one_of_each(docs).select(*_plain(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    trim_driver(spark)
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark")).select(*_plain(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    trim_driver(spark)
    batches_within(spark)
    return queries.bpe_digest(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE encoding and decoding", encode),
]

# SQL cannot train the classifier; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

"""Analyses that skip what was analysed before.

Results are stored per (repo, path, content hash): the same text at the same place is
never analysed twice, and a changed text becomes a new version.

The store is a table in buckets of that key, so reading it for a join by the key moves none
of its rows. A stream keeps the versions it has seen in Spark's state store, by file; a
micro-batch reads the state of its own files and no others.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from srcframe.functions.lines import content_hash
from srcframe.functions.python_code import python_metrics
from srcframe.operators.pymetrics import python_only, total_complexity
from srcframe.operators.stats import file_stats
from srcframe.operators.membership import keep_members
from srcframe.session import broadcast_if_small, fits_broadcast, materialize

KEY = ["repo", "path", "content_hash"]
# Buckets of a store; it keeps the number it was made with.
STORE_BUCKETS = 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_versions(files: DataFrame) -> DataFrame:
    """(repo, path, content_hash) of every file."""
    return files.select("repo", "path", content_hash(F.col("content")).alias("content_hash"))


def unseen_versions(files: DataFrame, known: DataFrame) -> DataFrame:
    """File versions that ``known`` does not hold.

    Keys are unique, so they spread evenly whatever the size of a repository, and the
    texts stay out of the shuffle.
    """
    return file_versions(files).join(known.select(*KEY), KEY, "left_anti")


def stored_results(files: DataFrame, known: DataFrame) -> DataFrame:
    """Every file version with its stored results; nulls where there are none yet."""
    return file_versions(files).join(known, KEY, "left")


def analyse(files: DataFrame) -> DataFrame:
    """Line statistics and Python metrics per file, in one pass.

    A file of an unknown language, and a Python file without metrics (no valid syntax), is
    stored as such and is not tried again.
    """
    python = python_only(F.col("content"), F.col("suffix")).alias("_python")
    parsed = file_stats(files, python, unknown=True).withColumn("_parsed", python_metrics("_python"))
    functions = F.col("_parsed.functions")
    return parsed.select(
        *KEY, "language", "code", "blank", "comment",
        F.when(functions.isNotNull(), F.size(functions)).cast("bigint").alias("function_count"),
        total_complexity(functions).alias("total_complexity"),
    )


def analyse_changes(
    files: DataFrame, known: DataFrame,
    job: Callable[[DataFrame], DataFrame] = analyse, version: int = 0,
) -> DataFrame:
    """Results of ``job`` for the unseen versions only, ready to append to the store.

    Where most files are new, all are analysed in the scan, each text read and hashed once,
    and the narrow results are tested against the store. Where few are, their keys are found
    first and tested in the scan, so only their texts are analysed. No text is shuffled.
    """
    known = known.select(*KEY)
    if 2 * known.count() < files.count():
        results = job(files).join(known, KEY, "left_anti")
    else:
        fresh = materialize(unseen_versions(files, known))
        if fits_broadcast(fresh):
            todo = files.join(F.broadcast(fresh.select("repo", "path").distinct()), ["repo", "path"], "left_semi")
        else:
            todo = keep_members(files, fresh.select("repo", "path").distinct(), ["repo", "path"])
        results = job(todo).join(broadcast_if_small(fresh), KEY, "left_semi")
    # Repeats are dropped from the narrow results, not from the texts.
    return results.dropDuplicates(KEY).withColumn("version", F.lit(version).cast("bigint"))


def current_results(versions: DataFrame, store: DataFrame) -> DataFrame:
    """Stored results of the current ``versions`` (repo, path, content_hash).

    What is current is told by the files and not by the order of the store: a text that
    came back has its old results, and removed files have none.
    """
    rest = [c for c in store.columns if c not in KEY]
    known = store.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("r"))
    return versions.select(*KEY).join(known, KEY).select(*KEY, "r.*")


def latest_versions(states: DataFrame) -> DataFrame:
    """The last version of every file from (run, repo, path, content_hash) rows.

    For runs that each see some of the files; a run over all files has no need of it. A file
    whose last row has no hash was removed.
    """
    last = states.groupBy("repo", "path").agg(F.max(F.struct("run", F.col("content_hash"))).alias("last"))
    return last.where(F.col("last.content_hash").isNotNull()).select("repo", "path", "last.content_hash")


def store_table(spark: SparkSession, folder: str, schema: T.StructType) -> str:
    """The name of the store in ``folder`` as a table in buckets of :data:`KEY`; made if new."""
    name = f"srcframe_store_{hashlib.sha256(os.path.abspath(folder).encode()).hexdigest()[:16]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = os.path.abspath(folder) if "://" not in folder else folder
    quoted = place.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"create table if not exists {name} ({columns}) using parquet "
        f"clustered by ({', '.join(KEY)}) into {STORE_BUCKETS} buckets location '{quoted}'")
    spark.sql(f"refresh table {name}")
    return name


def open_store(spark: SparkSession, folder: str, files: DataFrame, job=analyse) -> DataFrame:
    """The stored results of ``job``, empty before the first run."""
    schema = T.StructType([*job(files).schema.fields, T.StructField("version", T.LongType())])
    return spark.table(store_table(spark, folder, schema))


def append_results(results: DataFrame, store: DataFrame, folder: str) -> None:
    """Append to the store, one file for each bucket that gets rows."""
    name = store_table(results.sparkSession, folder, store.schema)
    results.select(*store.columns).repartition(STORE_BUCKETS, *KEY).write.insertInto(name)


def update_store(
    files: DataFrame, folder: str, version: int, job=analyse, states: str | None = None
) -> DataFrame:
    """Analyse what changed and append it; ``version`` is the number of the run. Returns the store.

    With ``states`` the run's (run, repo, path, content_hash) rows are appended there.

    A repeated run finds its versions stored and appends nothing, so it is safe to retry.
    """
    spark = files.sparkSession
    known = open_store(spark, folder, files, job)
    append_results(analyse_changes(files, known, job, version), known, folder)
    if states:
        seen = file_versions(files).withColumn("run", F.lit(version).cast("bigint"))
        seen.write.mode("append").parquet(states)
    return open_store(spark, folder, files, job)


def seen_in_state(files: DataFrame) -> DataFrame:
    """Every row of a streaming files table with ``content_hash`` and ``unseen``.

    The state of a file is the set of the versions seen of it. A row whose ``removed`` is
    true is a tombstone: its hash is null. Texts of seen versions are not handed on.
    """
    gone = F.col("removed") if "removed" in files.columns else F.lit(False)
    rows = files.withColumn("removed", F.coalesce(gone, F.lit(False)))
    rows = rows.withColumn("content_hash", F.when(~F.col("removed"), content_hash(F.col("content"))))
    shape = T.StructType([*rows.schema.fields, T.StructField("unseen", T.BooleanType())])
    names = rows.columns

    def mark(key, frames, state):
        import pandas as pd

        known = set(state.get[0]) if state.exists else set()
        before = len(known)
        for frame in frames:
            fresh = []
            for version in frame["content_hash"]:
                fresh.append(version is not None and version not in known)
                if version is not None:
                    known.add(version)
            out = frame[names].copy()
            out["unseen"] = pd.Series(fresh, index=out.index, dtype="bool")
            out["content"] = out["content"].where(out["unseen"], None)
            yield out
        if len(known) > before:
            state.update((sorted(known),))

    return rows.groupBy("repo", "path").applyInPandasWithState(mark, shape, "versions array<string>", "append", "NoTimeout")


def start_stream(
    files: DataFrame, folder: str, checkpoint: str, job=analyse, states: str | None = None,
    first_run: int = 0, **trigger,
):
    """Analyse the versions of a streaming files table that were not seen before.

    What was seen is kept by file in the stream's state, on the executors' disks and in the
    checkpoint, so a micro-batch reads neither the store nor the keys of other files. With
    ``states`` every row's (run, repo, path, content_hash) is appended there; a row of a
    column ``removed`` is a tombstone without a hash. A micro-batch that is repeated gives
    the same rows again: results are read by key, so they count once.

    Batches count from 0 in a new checkpoint; give it a ``first_run`` above all runs so far.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    plain = files.drop("removed")

    def batch(rows: DataFrame, batch_id: int) -> None:
        run = F.lit(first_run + batch_id).cast("bigint")
        marked = rows.persist()
        try:
            todo = marked.where("unseen").select(*plain.columns, "content_hash")
            results = job(todo).dropDuplicates(KEY).withColumn("version", run)
            store = spark.table(store_table(spark, folder, results.schema))
            append_results(results, store, folder)
            if states:
                marked.select(*KEY, run.alias("run")).write.mode("append").parquet(states)
        finally:
            marked.unpersist()

    return (
        seen_in_state(files).writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

"""Session defaults and the few helpers that need the session itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# A side is only broadcast after its bytes were counted and found under this bound.
BROADCAST_BYTES = 64 << 20
# Most bytes of a bitset of keys; its size follows from their number.
BITSET_BYTES = 64 << 20


def build_session(app: str = "srcframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are tuned for; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Texts are long: small splits keep a task's batch of texts in memory.
        "spark.sql.files.maxPartitionBytes": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Where none is named, a folder below the warehouse, which all executors share as well:
    a machine-local folder would be lost with its executor.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    spark.sparkContext.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the stored rows.

    For narrow tables that are read more than once, or whose rows must not change
    between two reads. Stored rows survive the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that a later filter tests.

    A filter on a plain projection is pushed below it, and the column is then computed
    for the filter and again for the result. Filters stay above a generator. The same
    holds for arrays to explode, as Spark adds a filter on their size.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _row_bytes(df: DataFrame) -> Column:
    total = F.lit(16)
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(col), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
        elif isinstance(field.dataType, _FIXED):
            total = total + 8
        else:
            raise TypeError(f"no size known for {field.dataType}")
    return total


def measured_bytes(df: DataFrame) -> int:
    """Bytes held by ``df``, counted by Spark."""
    return df.select(F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    return measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast of ``df`` only when its counted size is under ``limit``.

    Otherwise the plain table comes back and the join shuffles on its keys, where
    adaptive execution splits skewed partitions. ``df`` should already be stored
    (:func:`materialize`) or be cheap to read twice.
    """
    return F.broadcast(df) if fits_broadcast(df, limit) else df

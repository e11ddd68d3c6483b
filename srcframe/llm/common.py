"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

# Texts are handed to a Python function in pieces of about this many bytes.
PIECE_BYTES = 8 << 20
# Those of map_texts: a piece is there as texts, as results and as Arrow values at once.
MAPPED_BYTES = 1 << 20
# Most bytes of an Arrow batch that batches_within lets Spark make.
BATCH_BYTES = 8 << 20
# A vectored read puts a whole row group into a buffer outside the heap, which stays with its thread, and from there
# into the heap. Read as a stream it is in the heap only.
STREAMED = {"parquet.hadoop.vectored.io.enabled": "false"}


def load(spark: SparkSession, folder: str, table: str, **options: str) -> DataFrame:
    return spark.read.options(**options).parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends here.

    The folder is the session's ``spark.checkpoint.dir``; see :mod:`srcframe.session`.
    """
    from srcframe.session import materialize

    return materialize(df)


def per_worker(key: tuple, make: Callable):
    """An object that all tasks of one Python worker share, such as a loaded vocabulary.

    Functions travel to the tasks with their modules, so a module variable would be new in
    every task. Only for tables that save time; results never depend on them. A worker
    keeps the last object asked for, so the tables of earlier stages do not add up.
    """
    import sys
    import types

    held = vars(sys.modules.setdefault("_srcframe_worker", types.ModuleType("_srcframe_worker")))
    found = held.get("last", (None, None))
    if found[0] != key:
        if held.pop("last", None):
            found = None
            trim_memory()
        found = held["last"] = key, make()
    return found[1]


def release_worker() -> None:
    """Let the object that :func:`per_worker` holds go, where a later step has no use for it."""
    import sys

    module = sys.modules.get("_srcframe_worker")
    if module is not None and vars(module).pop("last", None):
        trim_memory()


def trim_memory() -> None:
    """Give freed memory of this process back to the machine."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Let the driver drop what earlier steps left: broadcasts, plans and memory that is free."""
    trim_memory()
    spark.sparkContext._jvm.java.lang.System.gc()


def batches_within(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Let the session cut Arrow batches at ``limit`` bytes, where it has no smaller bound.

    Spark's own is 64 MB and 10,000 rows: a task holds such a batch in the JVM, outside its
    heap, and again in its Python worker. Rows and results stay the same.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    current = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if current > limit:
        spark.conf.set(name, f"{limit}b")


def own_name(df, name: str) -> str:
    """A column name that ``df`` (or a list of names) does not have, whatever the case."""
    taken = {c.lower() for c in getattr(df, "columns", df)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(batch, column: str, limit: int = PIECE_BYTES) -> Iterator:
    """Cut an Arrow batch into runs of rows whose ``column`` holds about ``limit`` bytes."""
    sizes = batch.column(column)
    start = size = 0
    for row in range(batch.num_rows):
        value = sizes[row]
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= limit:
            yield batch.slice(start, row + 1 - start)
            start, size = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start, batch.num_rows - start)


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply a Python function to pieces of a text column, in place (no shuffle).

    ``make()`` runs once per task and returns a function from a list of texts (``None``
    read as ``''``) to a tuple of lists, the new columns of ``schema``. The columns of
    ``keep`` stand before them.
    """
    import pyspark.sql.types as T

    added = T._parse_datatype_string(schema)
    kept = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    # plain names on the way, as those of a table may hold dots
    out = T.StructType([*kept.schema.fields, *[T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added.fields)]])
    narrow = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("text"))

    def run(batches):
        import itertools

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(out)
        work = make()
        def mapped(batch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            columns = [batch.column(i).cast(shape.field(i).type) for i in range(len(keep))]
            for values, field in zip(work(texts), list(shape)[len(keep):], strict=True):
                columns.append(pa.array(values, type=field.type))
            return pa.RecordBatch.from_arrays(columns, schema=shape)

        # no name holds a batch while the next one is read
        cut = map(lambda whole: pieces(whole, "text", MAPPED_BYTES), batches)
        yield from map(mapped, itertools.chain.from_iterable(cut))

    return narrow.mapInArrow(run, out).toDF(*keep, *[f.name for f in added.fields])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    import uuid

    from srcframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

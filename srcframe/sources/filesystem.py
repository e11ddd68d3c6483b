"""Reading real directories.

Spark's own file sources skip names that start with a dot or an underscore, so directories
are walked here, in rounds: a frontier of unopened directories is spread over tasks, each of
which opens some of its share and leaves the rest to the next round. Listing and reading are
separate steps: the listing holds no bytes, and only then are the files opened.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from srcframe.constants import DEFAULT_IGNORED_DIRS
from srcframe.functions.decode import decode_text
from srcframe.schemas import RAW_FILES
from srcframe.session import materialize
from srcframe.sources.tables import files_from_table

# Directories that a task opens in the first round, and by how much that grows: small shares
# first, so that a tree that hangs on few directories is soon known to all tasks.
FIRST_SHARE, GROWTH, MOST_SHARE = 64, 8, 32_768
# Rows of a listing that a task hands on together.
LISTED_ROWS = 1_024
# Systems take paths up to some 4,096 bytes; longer ones are opened step by step.
PATH_STEP = 2_048

# A frontier row: a directory that is known and not yet opened; the root has the path "".
_WALKED = T.StructType([*RAW_FILES.fields, T.StructField("root", T.StringType()), T.StructField("unopened", T.BooleanType())])


def _open(location: str, flags: int) -> int:
    """A descriptor of ``location``, whatever the length of the path."""
    if len(os.fsencode(location)) <= PATH_STEP:
        return os.open(location, flags)
    at, step = None, "/" if location.startswith("/") else "."
    names = deque(n for n in location.split("/") if n)
    try:
        while True:
            while names and len(os.fsencode(step)) + len(os.fsencode(names[0])) < PATH_STEP:
                step = os.path.join(step, names.popleft())
            found = os.open(step, (os.O_RDONLY | os.O_DIRECTORY) if names else flags, dir_fd=at)
            if at is not None:
                os.close(at)
            at = found
            if not names:
                at = None
                return found
            step = names.popleft()
    finally:
        if at is not None:
            os.close(at)


def _entries(location: str, is_root: bool) -> Iterator[tuple[str, int, bool, bool]]:
    """(name, size, is a link, is a directory) of a directory; nothing where it can't be read."""
    if is_root:
        if not os.path.exists(location):
            raise FileNotFoundError(location)
        if not os.path.isdir(location):
            raise NotADirectoryError(location)
    try:
        opened = _open(location, os.O_RDONLY | os.O_DIRECTORY)
    except OSError:
        return
    try:
        with os.scandir(opened) as found:
            for entry in found:
                try:
                    entry.name.encode()
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.name, 0, False, True
                    elif entry.is_symlink() or entry.is_file(follow_symlinks=False):
                        yield entry.name, entry.stat(follow_symlinks=False).st_size, entry.is_symlink(), False
                except (OSError, UnicodeEncodeError):
                    continue
    except OSError:
        return
    finally:
        os.close(opened)


def _walk(share: int, skip_dirs: frozenset[str], hidden: bool):
    """The function of one round: rows of what is listed, and of directories left unopened."""
    def opened(repo, root, first):
        """Breadth first, at most ``share`` directories by all calls of a task."""
        nonlocal left
        waiting = deque([first])
        while waiting and left > 0:
            left -= 1
            folder = waiting.popleft()
            for name, size, link, is_dir in _entries(f"{root}/{folder}" if folder else root, not folder):
                if is_dir and (name in skip_dirs or not hidden and name.startswith(".")):
                    continue
                path = f"{folder}/{name}" if folder else name
                yield repo, path, size, link, is_dir, f"{root}/{path}", root, False
                if is_dir:
                    waiting.append(path)
        for path in waiting:
            yield repo, path, 0, False, True, f"{root}/{path}", root, True

    left = share

    def run(batches):
        nonlocal left
        left = share
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_WALKED)
        rows = []
        for batch in batches:
            for repo, root, path in zip(*[batch.column(c).to_pylist() for c in ("repo", "root", "path")]):
                for row in opened(repo, root, path):
                    rows.append(dict(zip(schema.names, row)))
                    if len(rows) >= LISTED_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def list_repos(
    spark: SparkSession,
    roots: Sequence[str] | Mapping[str, str] | DataFrame,
    enter_hidden: bool = True,
    skip_dirs: Sequence[str] = DEFAULT_IGNORED_DIRS,
    partitions: int | None = None,
) -> DataFrame:
    """Listing of ``roots`` (paths, repository name to path, or a table (repo, root)); no file is opened.

    ``enter_hidden`` is about directories; hidden files are always listed, as rule files
    are among them. A missing root is an error, as is a root that is no directory; both are
    found in tasks. Directories and files that can't be read, and names that are no UTF-8, are
    left out. Roots must be visible to all executors (a shared mount).

    The walk takes place here, in rounds of growing shares (up to ``MOST_SHARE`` directories a
    task), so there are few of them for a deep chain as for a wide tree. Every round is stored.
    One directory is listed by one task, row after row.
    """
    if isinstance(roots, DataFrame):
        known = roots.select(F.col("repo").cast("string"), F.col("root").cast("string"))
        if not known.groupBy("repo").count().where("count > 1").isEmpty():
            raise ValueError("two roots have the same name")
    else:
        pairs = list(roots.items()) if isinstance(roots, Mapping) else [
            (os.path.basename(os.path.abspath(r)), r) for r in roots]
        if len({repo for repo, _ in pairs}) < len(pairs):
            raise ValueError("two roots have the same name; give the names as a mapping")
        known = spark.createDataFrame([(repo, os.path.abspath(root)) for repo, root in pairs], "repo string, root string")
    count = partitions or spark.sparkContext.defaultParallelism * 4
    frontier, share = known.withColumn("path", F.lit("")), FIRST_SHARE
    listed = spark.createDataFrame([], RAW_FILES)
    while True:
        work = _walk(share, frozenset(skip_dirs), enter_hidden)
        # an even spread, also of a frontier that hangs below one directory
        found = materialize(frontier.select("repo", "root", "path").repartition(count).mapInArrow(work, _WALKED))
        listed = listed.unionByName(found.where(~F.col("unopened")).select(*RAW_FILES.names))
        frontier, share = found.where("unopened"), min(share * GROWTH, MOST_SHARE)
        if frontier.isEmpty():
            return listed


# A batch of files is handed on once it holds this many bytes.
BATCH_BYTES = 32 << 20


def _read_batches(batches):
    import pyarrow as pa

    def made(batch, first, rows):
        part = batch.slice(first, len(rows))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.binary())], names=[*part.schema.names, "bytes"])

    for batch in batches:
        first, held, rows = 0, 0, []
        for location in batch.column("location").to_pylist():
            try:
                with os.fdopen(_open(location, os.O_RDONLY), "rb") as handle:
                    rows.append(handle.read())
                held += len(rows[-1])
            except (OSError, TypeError):
                rows.append(None)
            if held >= BATCH_BYTES:
                yield made(batch, first, rows)
                first, held, rows = first + len(rows), 0, []
        if rows:
            yield made(batch, first, rows)


def read_bytes(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """The files of a listing with their ``bytes``; links and unreadable files are left out."""
    spark = listing.sparkSession
    wanted = listing.where(~F.col("is_symlink") & ~F.col("is_dir"))
    count = partitions or spark.sparkContext.defaultParallelism * 4
    spread = wanted.repartition(count, F.xxhash64("repo", "path"))
    schema = T.StructType([*spread.schema.fields, T.StructField("bytes", T.BinaryType())])
    return spread.mapInArrow(_read_batches, schema).where(F.col("bytes").isNotNull())


# Rows of a Parquet file that are decoded together hold about this many bytes, and are no more than this.
DECODED_BYTES, DECODED_ROWS = 8 << 20, 65_536


def _opened(location):
    """The file, or nothing where it can't be read."""
    try:
        return os.fdopen(_open(location, os.O_RDONLY), "rb")
    except (OSError, TypeError):
        return None


def _row_groups(batches):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        for repo, path, location in zip(*[batch.column(c).to_pylist() for c in ("repo", "path", "location")]):
            handle = _opened(location)
            if handle is None:
                continue
            with handle:
                # a file without any has a row, too
                groups = max(1, pq.ParquetFile(handle).metadata.num_row_groups)
            yield pa.RecordBatch.from_pydict({
                "repo": [repo] * groups, "path": [path] * groups, "location": [location] * groups, "group": pa.array(range(groups), pa.int32())})


def _read_rows(batches):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def rows(handle, group):
        file = pq.ParquetFile(handle, buffer_size=1 << 20, pre_buffer=False)
        if group >= file.metadata.num_row_groups:
            return 0
        held = file.metadata.row_group(group)
        size = DECODED_BYTES * held.num_rows // max(1, held.total_byte_size)
        return sum(b.num_rows for b in file.iter_batches(min(max(1, size), DECODED_ROWS), row_groups=[group], use_threads=False))

    for batch in batches:
        for repo, path, location, group in zip(*[c.to_pylist() for c in batch.columns]):
            handle = _opened(location)
            if handle is None:
                continue
            with handle:
                yield pa.RecordBatch.from_pydict({"repo": [repo], "path": [path], "n_rows": pa.array([rows(handle, group)], pa.int64())})


def parquet_rows(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """(repo, path, n_rows) of the Parquet files of a listing; links and unreadable files are left out.

    All columns are read and their rows counted, a row group in a task and some rows of it at a
    time; so no task holds a file, whatever its size.
    """
    count = partitions or listing.sparkSession.sparkContext.defaultParallelism * 4
    wanted = listing.where(~F.col("is_symlink") & ~F.col("is_dir")).select("repo", "path", "location")
    groups = wanted.repartition(count, F.xxhash64("repo", "path")).mapInArrow(
        _row_groups, "repo string, path string, location string, group int")
    read = groups.repartition(count, F.xxhash64("location", "group")).mapInArrow(_read_rows, "repo string, path string, n_rows bigint")
    return read.groupBy("repo", "path").agg(F.sum("n_rows").alias("n_rows"))


def read_contents(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """The files of a listing with their texts; links and unreadable files are left out."""
    return files_from_table(
        read_bytes(listing, partitions), content=decode_text(F.col("bytes")), disk_size="disk_size", is_symlink="is_symlink"
    )


def scan_repos(spark: SparkSession, roots, **options) -> DataFrame:
    """Walk and read the roots: the ``files`` table of real directories."""
    return read_contents(list_repos(spark, roots, **options))

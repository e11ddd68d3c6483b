"""Exact top-k search by inner product with MaxScore, over shards of the vectors.

Components become integers, ``floor(scale * x)``. A term is a dimension with a sign; its
posting list in a shard holds the rows whose component has that sign. A query's terms are
its components; only rows of the same sign add to the score, by at most the query's
component times the largest one in the list. Terms are taken by falling bound. While an
unseen row could still reach the k-th best score the term is essential and its list is
traversed; the rest are only probed for rows that stay competitive. What rows of the other
sign take away is counted in the exact score of those left.

Every query meets every shard, in blocks of queries; each gives its k best, which are
merged per query.

Defined results: vectors (or ids) that are null, or hold a null or non-finite component,
take no part. Shorter vectors count as filled with zeros. Rows with the query's own id are
no candidates. Ties go to the smaller id. A component whose scaled value is more than 2^54 in
size counts as that. Shards in which a query's scores could need more than 64 bits are scored
in whole numbers of any size; ranks follow the exact scores, and one that does not fit is given
as the largest (smallest) 64-bit number.
"""

from __future__ import annotations

import decimal
import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS = 8192
# A component that is larger (or smaller) after scaling counts as this.
LARGEST = 1 << 54
# Bounds and sums below this are safe in 64 bits.
SAFE = 1 << 62
BLOCK_QUERIES = 1024
# Shards that share a copy of a block of queries, where there are enough for all cores.
SHARED_SHARDS = 64


def scaled(vectors: DataFrame, scale: int, key: str, column: str) -> DataFrame:
    """``vec_id`` and the integer components of the vectors that take part."""
    value = F.col(column)
    bound = F.lit(LARGEST).cast("double")
    fine = F.forall(value, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(value, lambda x: F.floor(F.greatest(-bound, F.least(bound, x.cast("double") * scale))).cast("bigint"))
    return vectors.where(F.col(key).isNotNull() & value.isNotNull() & fine).select(
        F.col(key).cast("bigint").alias("vec_id"), whole.alias("values"))


def _matrix(values, width: int):
    """Rows of unequal length, filled with zeros."""
    import numpy as np

    out = np.zeros((len(values), width), np.int64)
    offsets = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == lengths[0]).all():
        out[:, :lengths[0]] = flat[offsets[0]:offsets[-1]].reshape(len(lengths), -1)
    else:
        for i, (a, n) in enumerate(zip(offsets, lengths)):
            out[i, :n] = flat[a:a + n]
    return out


def packed(frame: DataFrame, rows: int) -> DataFrame:
    """Rows of a partition as shards: ids and components in two binary columns, in place."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def shard(parts):
            part = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            values = part.column("values")
            width = int(np.diff(values.offsets.to_numpy()).max(initial=0))
            return pa.RecordBatch.from_arrays([
                pa.array([part.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                pa.array([_matrix(values, width).tobytes()], pa.binary()),
                pa.array([width], pa.int32()),
            ], names=["ids", "components", "width"])

        waiting, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                waiting.append(batch.slice(at, rows - held))
                at, held = at + waiting[-1].num_rows, held + waiting[-1].num_rows
                if held == rows:
                    yield shard(waiting)
                    waiting, held = [], 0
        if held:
            yield shard(waiting)

    return frame.mapInArrow(run, "ids binary, components binary, width int")


class Shard:
    """Posting lists of one shard and the search in them."""

    def __init__(self, ids, matrix):
        import numpy as np

        self.ids, self.matrix = ids, matrix
        self.lists = {}
        # the largest size of each component, as exact numbers
        self.sizes = [int(n) for n in np.abs(matrix).max(axis=0, initial=0)]
        for d in range(matrix.shape[1]):
            column = matrix[:, d]
            for sign in (1, -1):
                rows = np.flatnonzero(column * sign > 0)
                if len(rows):
                    values = np.abs(column[rows])
                    self.lists[d, sign] = rows, values, int(values.max())

    def best(self, query_id: int, query, k: int):
        """The ``k`` best rows of the shard as (id, score), with all ties of the last one left out by id."""
        import numpy as np

        width = min(len(query), self.matrix.shape[1])
        others = self.ids != query_id
        if sum(abs(int(q)) * n for q, n in zip(query[:width], self.sizes)) >= SAFE:
            return self._wide(np.flatnonzero(others), query[:width], k)
        terms = []
        for d in np.flatnonzero(query[:width]):
            held = self.lists.get((int(d), 1 if query[d] > 0 else -1))
            if held:
                weight = int(abs(query[d]))
                terms.append((weight * held[2], weight, int(d), held))
        terms.sort(key=lambda t: -t[0])
        bounds = [t[0] for t in terms]
        left = sum(bounds)
        exact = lambda rows: self.matrix[rows, :width] @ query[:width]
        sums = np.zeros(len(self.ids), np.int64)
        sums[~others] = -(1 << 62)
        if others.sum() <= k:
            return self._first(np.flatnonzero(others), exact, k)
        least, at = None, 0
        # essential terms: a row met in none of the lists so far could still be among the best
        while at < len(terms) and (least is None or left >= least):
            bound, weight, _, (rows, values, _) = terms[at]
            sums[rows] += weight * values
            left -= bound
            at += 1
            if at % 8 == 0 or at == len(terms):
                likely = np.argpartition(-sums, k - 1)[:k]
                found = int(np.sort(exact(likely[others[likely]]))[0])
                least = found if least is None else max(least, found)
        if least is None:
            rows = np.flatnonzero(others)
        else:
            rows = np.flatnonzero((sums + left >= least) & others)
            while at < len(terms) and len(rows) > 4 * k:  # probing
                bound, weight, d, _ = terms[at]
                sign = 1 if query[d] > 0 else -1
                sums[rows] += weight * np.maximum(self.matrix[rows, d] * sign, 0)
                left -= bound
                at += 1
                rows = rows[sums[rows] + left >= least]
        return self._first(rows, exact, k)

    def _wide(self, rows, query, k: int):
        """Scores that may need more than 64 bits: whole numbers of any size, and no bounds."""
        import numpy as np

        whole = [int(q) for q in query]
        scored = ((-sum(a * b for a, b in zip(whole, self.matrix[row].tolist())), int(self.ids[row])) for row in rows)
        best = heapq.nsmallest(k, scored)
        return np.array([i for _, i in best], np.int64), [-s for s, _ in best]

    def _first(self, rows, exact, k: int):
        import numpy as np

        scores = exact(rows)
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[order]], scores[order].tolist()


def search(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best rows of each query.

    ``queries`` says which rows are queries. Shards are dealt into parts, and each part meets
    each block of queries in a group of its own. A task holds one shard and one block at a
    time. The groups are many small tasks of much work, so their number is set and not left
    to the sizes of the data.
    """
    whole = scaled(vectors, scale, key, column)
    asked = scaled(vectors.where(queries), scale, key, column)
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    shards = -(-vectors.count() // SHARD_ROWS)
    parts = max(1, -(-shards // SHARED_SHARDS), min(shards, vectors.sparkSession.sparkContext.defaultParallelism))
    asked = packed(asked.repartition(blocks, "vec_id"), BLOCK_QUERIES).select(
        F.col("ids").alias("q_ids"), F.col("components").alias("q_components"),
        (F.spark_partition_id() % blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    shards = packed(whole.repartition(parts, "vec_id"), SHARD_ROWS).withColumn("part", F.spark_partition_id() % parts)
    shards = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    groups = ["block", "part"]
    asked, shards = (df.repartition(blocks * parts, *groups) for df in (asked, shards))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept_ids, kept = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] != kept_ids:
                    ids = np.frombuffer(row["ids"], "<i8")
                    kept_ids, kept = row["ids"], Shard(ids, np.frombuffer(row["components"], np.int64).reshape(len(ids), -1))
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                asked_now = np.frombuffer(row["q_components"], np.int64).reshape(len(q_ids), -1)
                out = [(q, *kept.best(int(q), v, k)) for q, v in zip(q_ids, asked_now)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]), pa.int64()),
                    pa.array(np.concatenate([i for _, i, _ in out]) if out else [], pa.int64()),
                    pa.array([decimal.Decimal(s) for _, _, found in out for s in found], pa.decimal128(38, 0)),
                ], names=["query_id", "vec_id", "score"])

    met = shards.join(asked, groups).select("ids", "components", "q_ids", "q_components")
    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score decimal(38,0)")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.greatest(F.lit(-(1 << 63)), F.least(F.lit((1 << 63) - 1), "score")).cast("bigint").alias("score"))

"""Interaction of filters by wide packed counters.

A document's outcome under every order of the filters depends only on its mask (which
filters it fails) and its two labels. Each mask stands for one big integer with a field for
each of the 600 steps (120 orders of five filters) and each count. The integers of a part
are added up; a field of the sum is the count of documents at that step. Fields are as wide
as the number of rows needs, so none can run over into the next.

One pass over the texts gives narrow facts: part, mask of the four filters that need only
the text, and the text's hash. Equal texts share their mask, so they are counted before they
meet: the fifth filter (an earlier copy) needs only the smallest key of each hash. Tasks add
their integers by part, lots of tasks are added next, and one row for each part is unpacked.

Defined results: null texts are empty. A null ``source`` is the part ``''``. Rows without a
key have no earlier copy and are none. Rows that repeat a key are documents of their own; a
copy under the same key is no earlier one. Labels are joined by key; of repeated labels
the larger counts. An empty table has no part and gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcframe.llm.common import stored
from srcframe.session import broadcast_if_small, compute_once

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
# Lots that the tasks' sums of a part are added in before they meet.
LOTS = 64
# Sums that a task holds before it passes them on.
HELD = 512

LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5


def text_mask(words: Column, distinct: Column, text: Column) -> Column:
    """Bits of A, B, C and D."""
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = [
        words < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * words,
        100 * capitals.cast("bigint") > CAPITAL_PERCENT * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def facts(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc``, ``part``, ``mask`` and ``hash`` of every row: all that is needed of a text."""
    plain = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    split = compute_once(plain, _words=F.filter(F.split("_text", "[ \\t-\\r]+"), lambda w: w != ""))
    mask = text_mask(F.size("_words").cast("bigint"), F.size(F.array_distinct("_words")).cast("bigint"), F.col("_text"))
    return split.select("doc", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("hash"))


def label_flags(labels: DataFrame) -> DataFrame:
    """``doc``, ``good`` and ``toxic`` (0 or 1) of the rows where one is 1."""
    flag = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0)))
    held = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(
        flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return held.where((F.col("good") == 1) | (F.col("toxic") == 1))


def counted_masks(held: DataFrame, flags: DataFrame) -> DataFrame:
    """``part``, ``code`` (mask with bits 32 for good and 64 for toxic) and ``n``."""
    rows = held.groupBy("doc", "hash", "part", "mask").agg(F.count("*").alias("n"))
    named = rows.join(broadcast_if_small(flags), "doc", "left").na.fill(0, ["good", "toxic"])
    named = named.withColumn("code", F.col("mask") + 32 * F.col("good") + 64 * F.col("toxic"))
    known = F.col("doc").isNotNull()
    alike = named.groupBy("hash", "part", "code").agg(
        F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc", "n"))).alias("least"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unkeyed"))
    first = F.min("least.doc").over(Window.partitionBy("hash"))
    alike = alike.withColumn(
        "clean", F.col("unkeyed") + F.when(F.col("least.doc") == first, F.col("least.n")).otherwise(0))
    both = F.array(
        F.struct("part", "code", F.col("clean").alias("n")),
        F.struct("part", (F.col("code") + 16).alias("code"), (F.col("n") - F.col("clean")).alias("n")))
    return alike.select(F.inline(both)).where(F.col("n") > 0)


def outcomes():
    """0 or 1 by code, step (600, by order) and count."""
    import numpy as np

    codes = np.arange(128)
    mask, good, toxic = codes & 31, codes >> 5 & 1, codes >> 6
    out = np.zeros((128, len(ORDERS) * 5, len(COUNTS)), np.uint8)
    for number, order in enumerate(ORDERS):
        left = np.ones(128, bool)
        for step, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails = (mask & bit) > 0
            removed, redundant = left & fails, ~left & fails
            left = left & ~fails
            out[:, number * 5 + step] = np.column_stack([left, removed, redundant, mask == bit, removed & (good > 0), removed & (toxic > 0)])
    return out


def packed_masks(width: int) -> list[int]:
    """The big integer of every code, with fields of ``width`` bytes."""
    import numpy as np

    made = outcomes()
    held = np.zeros((128, made[0].size, width), np.uint8)
    held[:, :, 0] = made.reshape(128, -1)
    return [int.from_bytes(row.tobytes(), "little") for row in held]


def unpacked(total: int, width: int):
    """Counts by step and name."""
    import numpy as np

    fields = len(ORDERS) * 5 * len(COUNTS)
    raw = np.frombuffer(total.to_bytes(fields * width, "little"), np.uint8).reshape(fields, width)
    wide = np.zeros((fields, 8), np.uint8)
    wide[:, :width] = raw
    return wide.view("<i8")[:, 0].reshape(-1, len(COUNTS))


def field_width(rows: int) -> int:
    """Bytes in which a count of ``rows`` documents fits. No step counts a document twice."""
    return max(1, -(-rows.bit_length() // 8))


def packed_sums(masks: DataFrame, width: int) -> DataFrame:
    """``part`` and ``packed``: the sum of the integers of all documents of the part."""
    size = len(ORDERS) * 5 * len(COUNTS) * width

    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        lot = TaskContext.get().partitionId() % LOTS
        of_code, sums = packed_masks(width), {}

        def passed():
            return pa.RecordBatch.from_arrays([
                pa.array(list(sums), pa.string()), pa.array([lot] * len(sums), pa.int32()),
                pa.array([s.to_bytes(size, "little") for s in sums.values()], pa.binary())], names=["part", "lot", "packed"])

        for batch in batches:
            met = pa.Table.from_batches([batch]).group_by(["part", "code"]).aggregate([("n", "sum")])
            for part, code, n in zip(*[met.column(c).to_pylist() for c in ("part", "code", "n_sum")]):
                sums[part] = sums.get(part, 0) + n * of_code[code]
            if len(sums) > HELD:
                yield passed()
                sums.clear()
        yield passed()

    def meet(table):
        import pyarrow as pa

        total = sum(int.from_bytes(p.as_py(), "little") for p in table.column("packed"))
        return pa.table({
            "part": table.column("part").slice(0, 1), "lot": table.column("lot").slice(0, 1),
            "packed": pa.array([total.to_bytes(size, "little")], pa.binary())})

    shape = "part string, lot int, packed binary"
    sums = masks.select("part", F.col("code").cast("int").alias("code"), "n").mapInArrow(add, shape)
    sums = sums.groupBy("part", "lot").applyInArrow(meet, shape)
    return sums.groupBy("part").applyInArrow(meet, shape).select("part", "packed")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for every part, order of the filters and step, with what the filter does there."""
    held = stored(facts(docs, key, text, part))
    width = field_width(held.count())
    sums = packed_sums(counted_masks(held, stored(label_flags(labels))), width)

    def read(batches):
        import numpy as np
        import pyarrow as pa

        steps = np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))
        orders = [o for o in ORDERS for _ in range(5)]
        letters = np.array([FILTERS.index(letter) for o in ORDERS for letter in o])
        for batch in batches:
            for name, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
                counts = unpacked(int.from_bytes(packed, "little"), width)
                removed = counts[:, COUNTS.index("removed")]
                by_filter = np.array([removed[letters == i].sum() for i in range(len(FILTERS))], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(orders), pa.string()), pa.array(orders), pa.array(steps),
                     *[pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(COUNTS))], pa.array(by_filter[letters])],
                    names=["part", "filter_order", "step", *COUNTS, "shapley"])

    counts = ", ".join(f"{c} bigint" for c in (*COUNTS, "shapley"))
    return sums.mapInArrow(read, f"part string, filter_order string, step int, {counts}")

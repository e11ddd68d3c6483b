import math
import random

import pyspark.sql.functions as F
import pytest

from srcframe.llm import maxscore


def brute(rows, k):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    out = set()
    for q in whole:
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("rows, shard", [(300, 8192), (300, 64), (7, 3)])
def test_against_brute_force(spark, monkeypatch, rows, shard):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 16)
    rng = random.Random(rows)
    made = [(i, [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(12)]) for i in range(rows)]
    made[3] = (3, list(made[4][1]))  # a tie
    df = spark.createDataFrame([(i, v, "x") for i, v in made], "vec_id bigint, embedding array<float>, rank string").repartition(3)
    found = maxscore.search(df, F.col("vec_id") % 5 == 0)
    held = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert {tuple(r) for r in found.collect()} == brute(held, 10)


def test_odd_vectors_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [float("inf"), 1.0]), (5, [2.0]), (None, [9.0, 9.0]), (10, []), (11, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = {tuple(r) for r in maxscore.search(df, F.col("vec_id") % 5 == 0, k=2).collect()}
    one = 1024
    assert found == {
        (0, 1, 5, 2 * one * one), (0, 2, 10, 0), (5, 1, 0, 2 * one * one), (5, 2, 10, 0), (10, 1, 0, 0), (10, 2, 5, 0)}
    assert maxscore.search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e12, 1e12, 1.0]), (1, [1e12, 1e12, 0.0]), (2, [1e12, -1e12, 5.0]), (3, [-1e12, -1e12, 0.0]), (4, [0.5, 0.0, 0.0]), (5, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = [tuple(r) for r in maxscore.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    most, one = (1 << 63) - 1, int(1024 * 1e12)
    assert [r[2] for r in found] == [5, 1, 4, 2, 3] and [r[3] for r in found] == [most, most, one * 512, 5 * 1024 * 1024, -most - 1]


def test_shards_are_filled_across_batches(spark):
    df = spark.range(3000).selectExpr("id as vec_id", "array(1L, id) as values").coalesce(1)
    sizes = sorted(len(r.ids) // 8 for r in maxscore.packed(df, 2048).collect())
    assert sizes == [952, 2048]  # batches of 512 rows

"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcframe.llm import merkle_manifest as M

SHAPE = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, i int, node string, leaf string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i:i + 3]) for i in range(0, len(last), 3)])
    return levels


def proof(levels, i):
    steps = []
    for nodes in levels[:-1]:
        start = i // 3 * 3
        steps.append((nodes[start:i], nodes[i + 1:start + 3]))
        i //= 3
    return steps


def tampered(row):
    text = row[4]
    if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
        text = text.replace("\n", "")
    return (*row[:4], text)


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in order:
        mine = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[name] = mine, levels_of([leaf(r) for r in mine])
    top = levels_of([built[name][1][-1][0] for name in order])
    out = []
    for k, name in enumerate(order):
        mine, levels = built[name]
        for i, row in enumerate(mine):
            steps = proof(levels, i) + proof(top, k)
            node = leaf(tampered(row))
            for left, right in steps:
                node = sha(*left, node, *right)
            flat = [h for left, right in steps for h in (*left, *right)]
            out.append((row[0], leaf(row), levels[-1][0], top[-1][0], sha(*flat), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest(spark, rows, **given):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SHAPE)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in M.manifest(docs, text, **given).collect()), key=str)


def some_rows():
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "Z", None, ""]), rng.choice(["en", None]), i, rng.choice(["x\ny", "z", None, "", "é\n🎉"])) for i in range(130)]
    rows += [(500, "lone", "en", 3, "a\nb"), (7, "a", "en", 1, "again"), (7, "a", "en", 1, "again"), (None, "a", None, None, None), (None, "a", None, None, "t\n")]
    rows += [(600 + i, f"s{i}", "en", 1, "t\nu") for i in range(10)]
    return rows


def test_equal_to_plain_trees(spark):
    rows = some_rows()
    got = manifest(spark, rows)
    assert got == plain_manifest(rows)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


@pytest.mark.parametrize("height", [1, 2])
def test_several_layers(spark, monkeypatch, height):
    # small sections, so that sources and the tree above them take several layers
    monkeypatch.setattr(M, "HEIGHT", height)
    monkeypatch.setattr(M, "SECTION", 3 ** height)
    rows = some_rows()
    assert manifest(spark, rows) == plain_manifest(rows)


def test_empty_table_and_single_rows(spark):
    assert manifest(spark, []) == []
    for row in [(1, None, None, None, None), (2, "s", "en", 3, "long\n" * 100_000)]:
        assert manifest(spark, [row]) == plain_manifest([row])


@pytest.mark.parametrize("full", [False, True])
def test_positions_are_the_places_in_the_log(full):
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80]:
        height = 4 if full else M.height_of(n)
        nodes = [str(i).encode() for i in range(n)]
        log = M.append_log(nodes, height)
        level = nodes
        for k in range(height + 1):
            places = M.position(k, np.arange(len(level)), n, height)
            assert [log[p] for p in places] == level
            level = [M.digest(*level[i:i + 3]) for i in range(0, len(level), 3)]
        assert len(log) == sum(-(-n // 3 ** k) for k in range(height + 1))


def test_no_text_leaves_the_scan(spark):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in some_rows()], SHAPE)
    plan = M.manifest(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "Cartesian" not in plan

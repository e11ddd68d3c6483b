import json
import random

import pytest
from pyspark.sql import functions as F

from srcframe.operators import pack


def greedy(rows, budget):
    """One pass in density order; ties keep walk order."""
    left, taken = budget, []
    for path, key, cost, density in sorted(rows, key=lambda r: (-r[3], r[1])):
        if 0 < cost and cost + 50 <= left:
            left -= cost + 50
            taken.append(path)
    return taken


def selection(spark, repos, budget):
    rows = [(repo, *r) for repo, rs in repos.items() for r in rs]
    df = spark.createDataFrame(rows, "repo string, path string, walk_key string, cost bigint, density double")
    out = {}
    for r in pack.select_under_budget(df, budget).collect():
        out.setdefault(r.repo, []).append((r.pick_order, r.path))
    return {repo: [p for _, p in sorted(v)] for repo, v in out.items()}


def test_skips_what_does_not_fit_and_goes_on(spark):
    rows = [("a", "1a", 100, 9.0), ("b", "1b", 500, 8.0), ("c", "1c", 90, 7.0), ("d", "1d", 40, 7.0)]
    assert selection(spark, {"r": rows}, 300) == {"r": ["a", "c"]}


@pytest.mark.parametrize("budget, costs", [
    (300, (1, 200)), (2000, (1, 2000)), (5000, (1, 60)), (4000, (900, 1100)), (10_000, (1, 9950)),
])
def test_equals_the_greedy_pass(spark, budget, costs):
    rng = random.Random(budget)
    repos = {}
    for n in range(60):
        size = rng.choice([1, 5, 40, 300])
        shape = rng.choice(["any", "ties", "rising", "falling"])
        rows = []
        for i in range(size):
            cost = rng.randint(*costs)
            if shape in ("rising", "falling"):
                cost = costs[0] + (costs[1] - costs[0]) * i // size
                density = float(i if shape == "falling" else -i)
            else:
                density = rng.choice([1.0, 2.0]) if shape == "ties" else rng.random()
            rows.append((f"f{i}", f"1{i:05d}", cost, density))
        repos[f"r{n}"] = rows
    want = {k: greedy(v, budget) for k, v in repos.items()}
    assert selection(spark, repos, budget) == {k: v for k, v in want.items() if v}


def test_a_choice_of_many_files_under_a_large_budget(spark):
    """No state grows in a row: rounds of running sums, and few of them."""
    budget, n = 10_000_000, 120_000
    df = spark.range(n).select(
        F.lit("hot").alias("repo"), F.concat(F.lit("f"), "id").alias("path"), F.format_string("1%08d", "id").alias("walk_key"),
        (F.pmod(F.xxhash64("id"), F.lit(4000)) + 1).alias("cost"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9973)) / 7.0).alias("density"))
    rows = [tuple(r) for r in df.select("path", "walk_key", "cost", "density").collect()]
    chosen = pack.select_under_budget(df, budget)
    assert [r.path for r in chosen.orderBy("pick_order").collect()] == greedy(rows, budget)
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan


def test_one_repository_of_equal_copies(spark):
    rows = [(f"f{i}", f"1{i:06d}", 10, 1.0) for i in range(20_000)]
    got = selection(spark, {"hot": rows, "r": rows[:3]}, 6000)
    assert got == {"hot": [f"f{i}" for i in range(100)], "r": ["f0", "f1", "f2"]}


def test_the_rest_does_not_depend_on_the_size_of_a_repository(spark):
    budget = 3000
    df = spark.range(40_000).select(
        F.lit("hot").alias("repo"), F.col("id").cast("string").alias("path"),
        F.format_string("1%08d", "id").alias("walk_key"), (F.pmod(F.xxhash64("id"), F.lit(2900)) + 1).alias("cost"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 7.0).alias("density"),
    ).where(F.col("cost") + 50 <= budget)
    rows = [tuple(r) for r in df.select("path", "walk_key", "cost", "density").collect()]
    left = pack._competitive(df, budget)
    assert left.count() < 1500
    picked = pack.select_under_budget(df, budget).orderBy("pick_order").collect()
    assert [r.path for r in picked] == greedy(rows, budget)


def test_texts_are_not_part_of_the_selection(make_files):
    files = make_files({"a.md": "one two", "b.py": "def f():\n    pass\n"})
    chosen = pack.select_under_budget(pack.pack_candidates(pack.pack_inputs(files), 500), 500)
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Window" in line or "Aggregate" in line]
    assert shuffled and not any("content" in line for line in shuffled)


def test_inputs_and_candidates(make_files):
    files = make_files({
        "a.PNG": "x", "empty.txt": "", "big.txt": "y" * 2000, "nul.txt": "a\0", "ok.txt": "one two\nthree",
        "blank.txt": " \n ", "gen.txt": "# -- generated by srcframe --\nx", "gen2.txt": "x # -- generated by srcframe --",
        "m.py": "def f(a):\n    if a:\n        return 1\n", "skip.log": "x",
    })
    inputs = pack.pack_inputs(files, max_kb=1, exclude_suffixes=("LOG",))
    assert {r.path for r in inputs.collect()} == {"ok.txt", "blank.txt", "gen2.txt", "m.py"}
    got = {r.path: (r.cost, r.value) for r in pack.pack_candidates(inputs, 1000).collect()}
    assert got == {"ok.txt": (3, 2), "gen2.txt": (7, 1), "m.py": (10, 3 + 20 + 5)}
    assert pack.pack_candidates(inputs, 55).count() == 1


def test_documents(make_files):
    files = make_files({"a.txt": "one", "b/c.txt": "two\n\"q\""})
    selected = pack.select_under_budget(pack.pack_candidates(pack.pack_inputs(files)))
    texts = pack.selected_texts(selected, files)
    rule = "=" * 42
    order = [r.path for r in selected.orderBy("pick_order").collect()]
    blocks = {"a.txt": "one", "b/c.txt": "two\n\"q\""}
    want = "# -- generated by srcframe --\n\n" + "\n".join(
        f"{rule}\nFILE: {p}\n{rule}\n{blocks[p]}\n" for p in order)
    document = lambda fmt: "\n".join(r.text for r in pack.format_pack(texts, fmt).orderBy("repo", "key").collect())
    assert document("raw") == want
    data = json.loads(document("JSON"))
    assert list(data) == ["pack_date", "files"]
    assert data["files"] == [{"path": p, "content": blocks[p]} for p in order]
    with pytest.raises(ValueError):
        pack.format_pack(texts, "xml")
    stats = pack.pack_stats(texts).first()
    assert stats.files_selected == 2
    assert pack.pack_stats(texts, "chars4").first().final_token_count == -(-len(want) // 4)


def test_whole_documents_are_digested(spark, make_files):
    import hashlib

    rows = [(repo, f"{i}.txt", f"text {i} of {repo}\n\u00e9\U0001f600" * (i + 1)) for repo in ("a", "b", "c") for i in range(7)]
    files = make_files(rows)
    texts = pack.selected_texts(pack.select_under_budget(pack.pack_candidates(pack.pack_inputs(files))), files)
    documents = {}
    for r in pack.format_pack(texts).orderBy("repo", "key").collect():
        documents[r.repo] = f"{documents[r.repo]}\n{r.text}" if r.repo in documents else r.text
    want = {repo: (hashlib.md5(d.encode()).hexdigest(), len(d)) for repo, d in documents.items()}
    found = pack.document_digests(texts.repartition(5))
    assert {r.repo: (r.digest, r.chars) for r in found.collect()} == want and len(want) == 3
    assert pack.document_digests(texts.where("repo = 'none'")).count() == 0

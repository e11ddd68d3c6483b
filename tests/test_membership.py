"""Membership in the scan, and the operators that use it, with broadcasts of rows off."""

import random

import pytest
from pyspark.sql import functions as F

from srcframe import session
from srcframe.functions.globs import shell_regex
from srcframe.operators import ignore, membership, options, pack


@pytest.fixture
def no_broadcasts(monkeypatch, spark):
    """As if no list were small enough."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanged(df):
    """The columns that shuffles carry, by the lines of the physical plan below them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan


def keys(spark, values):
    return spark.createDataFrame([(v, f"p{v}") for v in values], "repo int, path string")


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_cascade_is_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(membership, "BITS", bits)  # few bits make many levels
    rng = random.Random(bits)
    every = list(range(3000))
    inside = set(rng.sample(every, 700))
    df = keys(spark, every).withColumn("content", F.lit("text"))
    members = keys(spark, sorted(inside))
    assert {r.repo for r in membership.keep_members(df, members, ["repo", "path"]).collect()} == inside
    left = membership.drop_members(df, members, ["repo", "path"])
    assert left.columns == df.columns and {r.repo for r in left.collect()} == set(every) - inside


def test_cascade_of_empty_sets(spark):
    df, none = keys(spark, [1, 2]), keys(spark, [])
    assert membership.keep_members(df, none, ["repo", "path"]).count() == 0
    assert membership.drop_members(df, none, ["repo", "path"]).count() == 2
    assert membership.keep_members(df, df, ["repo", "path"]).count() == 2
    assert membership.keep_members(none, df, ["repo", "path"]).count() == 0


def test_more_keys_than_a_bitset_holds_are_joined(spark, monkeypatch):
    monkeypatch.setattr(membership, "BITSET_BYTES", 0)
    df = keys(spark, range(50))
    assert membership.keep_members(df, keys(spark, range(0, 50, 7)), ["repo", "path"]).count() == 8
    assert membership.likely(df, keys(spark, [1]), ["repo", "path"]).count() == 50


def shuffled_columns(df):
    """Names of the columns that go through any shuffle of the plan."""
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    found = set()
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if " Exchange" in line and "BroadcastExchange" not in line:
            found |= set(re.findall(r"([A-Za-z_]\w*)#\d+", " ".join(lines[i:i + 2])))
    return found


def test_gitignore_without_broadcasts(spark, make_files, no_broadcasts):
    rng = random.Random(4)
    rules = "*.log\n!keep.log\nout/\n/top.txt\ndocs/**/*.tmp\nsub/deep/\n!sub/deep/x.py\n"
    names = ["a.log", "keep.log", "top.txt", "x.py", "y.tmp", "out", "README"]
    folders = ["", "out/", "sub/", "sub/deep/", "docs/", "docs/x/", "sub/out/", "sub/deep/er/", "outer/", "out/a/b/"]
    rows = [(r, f"{f}{n}", "text") for r in ("a", "b", "c") for f in folders for n in names if rng.random() < 0.8]
    rows += [("a", ".gitignore", rules), ("b", ".gitignore", "docs/\n*.py\n"), ("d", "z/out/k", "t")]
    files = make_files(sorted(set(rows)))
    got = ignore.apply_gitignore(files)
    assert "content" not in shuffled_columns(got)
    with_them = {(r.repo, r.path) for r in got.select("repo", "path").collect()}
    session.BROADCAST_BYTES = 64 << 20
    want = {(r.repo, r.path) for r in ignore.apply_gitignore(files).select("repo", "path").collect()}
    assert with_them == want and len(want) < len(set(rows))


def test_an_ignored_directory_is_one_interval(spark, make_files):
    rows = {".gitignore": "big/\n"} | {f"big/d{i % 9}/f{i}": "x" for i in range(300)} | {"bigger/f": "x", "big2": "y", "a/big": "z"}
    files = make_files(rows)
    matchers = ignore.combined_rules(ignore.ignore_rules(files))
    spans = ignore.ignored_intervals(files, matchers).collect()
    assert len([s for s in spans if "d" not in s.low]) == 1  # decisions grow with directories
    gone = {r.path for r in ignore.ignored_files(files, matchers).collect()}
    assert gone == {p for p in rows if p.startswith("big/")}


def test_exclusions_without_broadcasts(spark, make_files, no_broadcasts):
    config = spark.createDataFrame(
        [("r", ["build", "gen"], ["*.md", "t?.txt"]), ("s", None, ["[ab]*"]), ("u", ["x"], None), ("v", [], [])],
        "repo string, exclude_dirs array<string>, exclude_patterns array<string>")
    paths = ["build/a", "x/build/n", "n.md", "gen", "k", "t1.txt", "tt1.txt", "x/gen/y/z.md", "abc", "c"]
    files = make_files([(r, p, "text") for r in "rsuvw" for p in paths])
    got = options.apply_exclusions(files, config)
    assert "content" not in shuffled_columns(got)
    found = {(r.repo, r.path) for r in got.collect()}
    session.BROADCAST_BYTES = 64 << 20
    assert found == {(r.repo, r.path) for r in options.apply_exclusions(files, config).collect()}
    assert ("r", "x/gen/y/z.md") not in found and ("r", "gen") in found and ("w", "n.md") in found


def test_large_file_pointers_without_broadcasts(spark, make_files, no_broadcasts):
    pointer = "https://git-lfs.github.com/spec/v1\noid sha256:1\nsize 12345\n"
    globs = ["*.psd", "art/*", "data/*.b?n", "a[bc]d", "*", "x/*/y.very-long-literal-end", "exact.txt"]
    rng = random.Random(9)
    paths = ["a.psd", "art/b.psd", "data/q.bin", "data/z/q.bxn", "abd", "acd", "aad", "x/1/2/y.very-long-literal-end", "exact.txt", "no/exact.txt", "c.txt"]
    rows, want = [], set()
    import re

    for repo in range(12):
        mine = rng.sample(globs[:4] + globs[5:], 3) + (["*"] if repo == 11 else [])
        rows.append((f"r{repo}", ".gitattributes", "".join(f"{g} filter=lfs\n" for g in mine)))
        for p in paths:
            rows.append((f"r{repo}", p, pointer if rng.random() < 0.7 else "plain"))
            if rows[-1][2] == pointer and any(re.match(shell_regex(g).replace(r"\z", r"\Z"), p) for g in mine):
                want.add((f"r{repo}", p))
    marked = ignore.with_lfs(make_files(rows))
    assert "content" not in shuffled_columns(marked)
    got = marked.collect()
    assert {(r.repo, r.path) for r in got if r.is_lfs_pointer} == want
    assert all((r.real_size, r.size_bytes) == ((12345, 12345) if r.is_lfs_pointer else (None, r.disk_size)) for r in got)


def test_globs_meet_paths_by_their_literal_end(spark):
    patterns = spark.range(20_000).selectExpr("'r' as repo", "concat('*.ext', id) as pattern")
    pointers = spark.createDataFrame([("r", "a/b.ext7"), ("r", "c.ext77777"), ("q", "a/b.ext7")], "repo string, path string")
    found = ignore.managed_paths(pointers, patterns)
    assert [tuple(r) for r in found.collect()] == [("r", "a/b.ext7")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_selected_texts_without_broadcasts(spark, make_files, no_broadcasts):
    files = make_files([(f"r{i % 3}", f"f{i}.txt", f"text {i}") for i in range(2000)])
    chosen = files.where("cast(regexp_extract(path, '[0-9]+', 0) as int) % 100 = 7").select("repo", "path", F.lit(1).alias("pick_order"))
    got = pack.selected_texts(chosen, files)
    assert {r.path for r in got.collect()} == {f"f{i}.txt" for i in range(7, 2000, 100)}
    # what the join shuffles of the texts: the chosen, and few that pass by chance
    passed = membership.likely(files.select("repo", "path", "content"), chosen, ["repo", "path"])
    assert 20 <= passed.count() <= 30
    assert "content" not in shuffled_columns(passed)

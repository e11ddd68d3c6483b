import fnmatch
import random
import re

from pyspark.sql import functions as F

from srcframe.functions import globs, paths
from srcframe.operators import filters, ordering, tree


def test_name_parts(spark):
    names = [".bashrc", "x.", "a.tar.gz", "..foo", "Dockerfile", "A.PY", ".a.b", "Makefile", "a.b.", "...", "é.Ä"]
    all_paths = names + [f"d.x/{n}" for n in names]
    df = spark.createDataFrame([(p,) for p in all_paths], "path string")
    p = F.col("path")
    for row in df.select(
        "path", paths.file_name(p).alias("n"), paths.suffix(p).alias("s"), paths.parent_dir(p).alias("d"),
        paths.dir_parts(p).alias("parts"),
    ).collect():
        # The rule is that of the standard library's older releases: a trailing dot is no suffix.
        name = row.path.split("/")[-1]
        dot = name.rfind(".")
        assert row.n == name
        assert row.s == (name[dot:].lower() if 0 < dot < len(name) - 1 else ""), name
        assert row.d == ("d.x" if "/" in row.path else "")
        assert row.parts == (["d.x"] if "/" in row.path else [])


def test_walk_order(make_files):
    files = make_files({p: "x" for p in ["b.py", "a/z.py", "a/b/c.py", "a/b.py", "c/x", "A.py", "_x", "a-b/q", "a/b-/c"]})
    got = [r.path for r in ordering.walk_order(files).orderBy("ordinal").collect()]
    assert got == ["a/b/c.py", "a/b-/c", "a/b.py", "a/z.py", "a-b/q", "c/x", "A.py", "_x", "b.py"]


def test_walk_order_of_one_large_repository(spark, make_files):
    rng = random.Random(5)
    names = {f"{rng.choice('abc')}/{rng.choice('xyz')}/{i}" for i in range(3000)}
    files = make_files([("big", n, "") for n in names] + [("small", "a", "")])
    rows = ordering.walk_order(files).collect()
    got = [r.path for r in sorted((r for r in rows if r.repo == "big"), key=lambda r: r.ordinal)]
    assert got == sorted(names)
    assert sorted(r.ordinal for r in rows if r.repo == "big") == list(range(1, 3001))


def test_shell_globs_match_like_the_standard_library():
    rng = random.Random(7)
    for _ in range(4000):
        glob = "".join(rng.choice("ab*?[]!-^.&|~\\") for _ in range(rng.randint(0, 7)))
        name = "".join(rng.choice("ab-]^!.&|~[\\") for _ in range(rng.randint(0, 5)))
        regex = globs.shell_regex(glob).replace("\\z", "\\Z")
        assert bool(re.search(regex, name)) == fnmatch.fnmatchcase(name, glob), (glob, name)


def test_filters(make_files):
    files = make_files({p: "t" for p in [
        ".env", ".github/ci.yml", "src/.keep", "src/ok.py", "node_modules/m.js", "src/__pycache__/k.pyc",
        "build/o.py", "x.log", "rebuild/z.py", "a/.git/c",
    ]})

    def left(df):
        return {r.path for r in df.select("path").collect()}

    everything = left(files)
    assert everything - left(filters.drop_default_dirs(files)) == {
        "node_modules/m.js", "src/__pycache__/k.pyc", "a/.git/c"}
    assert everything - left(filters.drop_hidden(files)) == {".env", ".github/ci.yml", "src/.keep", "a/.git/c"}
    assert everything - left(filters.exclude_dirs(files, ["build", "src/"])) == {"build/o.py"}
    assert everything - left(filters.exclude_patterns(files, ["*.log", "[mo]k.*"])) == {"x.log", "src/ok.py"}
    assert left(filters.exclude_dirs(files, [])) == everything


def test_file_guard(make_files):
    import pytest

    files = make_files([("big", str(i), "") for i in range(5)] + [("small", "a", "")])
    assert {r.repo for r in filters.repos_within(files, 4).collect()} == {"small"}
    with pytest.raises(ValueError, match="big has 5"):
        filters.guard_max_files(files, 4)
    assert filters.guard_max_files(files, 5).count() == 6


def test_tree_round_trip(spark, make_files):
    import json

    content = {"b.py": "12345", "a/z.py": "1", "a/b/c \"q\".py": "22", "é/x": "333"}
    files = make_files(content)
    dirs = spark.createDataFrame([("r", "empty"), ("r", "a/none")], "repo string, path string")
    pieces = tree.nest_tree(files, dirs)
    document = json.loads("".join(r.text for r in pieces.orderBy("key").collect()))

    def flat(nodes, prefix=""):
        for n in nodes:
            yield prefix + n["name"], n["type"], n["size_bytes"]
            if n["type"] == "directory":
                yield from flat(n["children"], prefix + n["name"] + "/")

    want = [
        ("a", "directory", 3), ("a/b", "directory", 2), ('a/b/c "q".py', "file", 2), ("a/none", "directory", 0),
        ("a/z.py", "file", 1), ("empty", "directory", 0), ("é", "directory", 3), ("é/x", "file", 3), ("b.py", "file", 5),
    ]
    assert list(flat(document)) == want
    rows = tree.flatten_tree(pieces).collect()
    assert sorted((r.path, r.type, r.size_bytes) for r in rows) == sorted(w for w in want if w[1] == "file")
    sizes = {r.dir: r.size_bytes for r in tree.directory_sizes(files).collect()}
    assert sizes == {"a": 3, "a/b": 2, "é": 3}


def test_top_files_are_cut_before_the_shuffle(make_files):
    from srcframe.operators import keyfiles

    plan = keyfiles.largest_files(make_files({"a.py": "x"}), 10)._jdf.queryExecution().executedPlan().toString()
    # Read from the bottom: every shuffle has a cut to the first rows right below it.
    steps = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Exchange hash" in line]
    kinds = ["cut" if "WindowGroupLimit" in s else "shuffle" for s in steps]
    assert kinds.count("shuffle") == 2
    assert all(kinds[i + 1] == "cut" for i, k in enumerate(kinds) if k == "shuffle"), plan
    assert not any("content" in s for s in steps)

import re

import pytest

from srcframe.functions.globs import ignore_regex
from srcframe.operators import ignore, keyfiles, options


def left(df):
    return {r.path for r in df.select("path").collect()}


def test_ignore_file(make_files):
    rules = "*.log\n!keep.log\nout/\n/top.txt\ndocs/**/*.tmp\n# note\n\n"
    files = make_files({p: "x" for p in [
        "a.log", "keep.log", "out/keep.log", "sub/top.txt", "top.txt", "docs/x/y.tmp", "docs/y.tmp", "sub/out", "sub/keep.py",
    ]} | {".gitignore": rules, "sub/.gitignore": "keep.py\n"})
    assert left(ignore.apply_gitignore(files)) == {
        ".gitignore", "sub/.gitignore", "keep.log", "sub/top.txt", "sub/out", "sub/keep.py"}


def test_rules_stay_in_their_repository(make_files):
    files = make_files([("a", ".gitignore", "*.x"), ("a", "1.x", ""), ("b", "1.x", ""), ("b", ".gitignore", "")])
    kept = {(r.repo, r.path) for r in ignore.apply_gitignore(files).collect()}
    assert kept == {("a", ".gitignore"), ("b", ".gitignore"), ("b", "1.x")}


@pytest.mark.parametrize("line, hits, misses", [
    ("foo", ["foo", "a/foo", "foo/"], ["foox", "foo/x"]),
    ("/foo", ["foo"], ["a/foo"]),
    ("a/b", ["a/b"], ["x/a/b"]),
    ("foo/", ["foo/", "a/foo/"], ["foo"]),
    ("**/foo", ["foo", "a/b/foo"], ["afoo"]),
    ("abc/**", ["abc/x", "abc/x/y"], ["abc/", "abc"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
    ("*.py[co]", ["x.pyc", "d/x.pyo"], ["x.py", "x.pyd"]),
    ("f?o", ["foo", "fxo"], ["f/o", "fo"]),
    ("[!a]b", ["xb"], ["ab", "/b"]),
    ("\\#x", ["#x"], ["x"]),
    ("\\!x", ["!x"], ["x"]),
    ("sp\\ ", ["sp "], ["sp"]),
    ("tail  ", ["tail"], ["tail  "]),
    ("a**b", ["ab", "axxb"], ["a/b"]),
])
def test_ignore_patterns(line, hits, misses):
    regex, negated = ignore_regex(line)
    assert not negated
    for path in hits:
        assert re.fullmatch(regex, path, re.DOTALL), path
    for path in misses:
        assert not re.fullmatch(regex, path, re.DOTALL), path


def test_lines_without_a_rule():
    assert [ignore_regex(x) for x in ("", "   ", "# c", "/")] == [None] * 4
    assert ignore_regex("!x")[1] is True


def test_large_file_pointers(make_files):
    pointer = "https://git-lfs.github.com/spec/v1\noid sha256:1\nsize 12345\n"
    files = make_files({
        ".gitattributes": "*.psd filter=lfs diff=lfs\n# *.txt filter=lfs\n*.txt text\n",
        "art/a.psd": pointer, "art/b.psd": "no pointer", "c.txt": pointer, "d.psd": "x" + pointer,
    })
    rows = {r.path: (r.is_lfs_pointer, r.real_size, r.size_bytes) for r in ignore.with_lfs(files).collect()}
    assert rows["art/a.psd"] == (True, 12345, 12345)
    assert rows["art/b.psd"] == (False, None, 10)
    assert rows["c.txt"] == (False, None, len(pointer))
    assert rows["d.psd"][0] is False
    top = keyfiles.largest_files(ignore.with_lfs(files), 1).first()
    assert (top.path, top.size_bytes, top.is_lfs) == ("art/a.psd", 12345, True)


def test_largest_files_without_rows(make_files):
    assert keyfiles.largest_files(make_files({"a.py": "x"}), -1).count() == 0


def test_important_files(make_files, spark):
    files = make_files({p: "" for p in ["README.md", "x/DOCKERFILE", "a.YML", "mymain.rs", "plain.rs", "z.special"]})
    assert left(keyfiles.important_files(files)) == {"README.md", "x/DOCKERFILE", "a.YML", "mymain.rs"}
    assert "z.special" in left(keyfiles.important_files(files, {"suffix": [".SPECIAL"]}))
    assert keyfiles.rule_table(spark).count() == 9 + 6 + 11


def test_options(spark, make_files):
    config = spark.createDataFrame([("r", ["build"], ["*.md"]), ("s", None, None)],
                                   "repo string, exclude_dirs array<string>, exclude_patterns array<string>")
    def merged(**given):
        return {r.repo: (r.exclude_dirs, r.exclude_patterns) for r in options.merge_exclusions(config, **given).collect()}

    assert merged() == {"r": (["build"], ["*.md"]), "s": (None, None)}
    assert merged(dirs="") == {"r": ([], ["*.md"]), "s": ([], None)}
    assert merged(dirs=" a, b ,,", patterns="x") == {"r": (["a", "b"], ["x"]), "s": (["a", "b"], ["x"])}
    files = make_files([("r", "build/a", ""), ("r", "n.md", ""), ("r", "k", ""), ("s", "build/a", ""), ("t", "n.md", "")])
    kept = {(r.repo, r.path) for r in options.apply_exclusions(files, config).collect()}
    assert kept == {("r", "k"), ("s", "build/a"), ("t", "n.md")}
    row = options.merge_options(config.where("repo = 's'"), {"exclude_dirs": None, "flag": False, "n": 3, "x": ""}).first()
    assert row.n == 3 and "flag" not in row.asDict() and "x" not in row.asDict()

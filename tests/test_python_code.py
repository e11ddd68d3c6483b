import ast
import math

import pytest

from srcframe.functions.python_code import measure, skeleton
from srcframe.operators import distill, pymetrics

MODULE = '''
import os

def plain(a, b=1):
    """Doc."""
    if a and b or a:
        return 1
    elif a:
        return 2
    for x in a:
        pass
    else:
        pass
    while a:
        break
    try:
        pass
    except ValueError:
        pass
    except KeyError:
        pass
    else:
        pass
    assert a and b
    return [y for y in a if y if b] if a else 0

class K:
    @property
    def method(self):
        if self:
            return 1

async def later(q):
    def inner():
        if q:
            pass
    async for z in q:
        pass
    match q:
        case 1:
            pass
        case _:
            pass

if True:
    def nested_in_if():
        return lambda v: v if v else 0
'''


def test_scores():
    rows = measure(MODULE)["functions"]
    got = [(r["ord"], r["function_name"], r["complexity_score"]) for r in rows]
    # plain: 1 + if 1 + bool (1+1) + elif 1 + for/else 2 + while 1 + try 2+1 + assert 1 + ternary 1 + comp 1+2
    # later: 1 + async for 1 + match 2-1; the inner function does not count.
    assert got == [(0, "plain", 16), (1, "later", 3), (2, "nested_in_if", 2)]
    assert rows[0]["line_number"] == 4


def test_volume():
    facts = measure("def f(a):\n    return a + 1 + a\n\nx = -a\n")
    # Three operators of two kinds; five operands: (a + 1), a twice, 1, and the a outside.
    volume = 8 * math.log2(2 + 4)
    assert facts["halstead_volume"] == pytest.approx(volume)
    assert facts["halstead_effort"] == pytest.approx(2 / 2 * 5 / 4 * volume)
    assert measure("x = 1\n")["halstead_volume"] == 0.0


@pytest.mark.parametrize("text", ["", "  \n", "def (", "x = '\0'"])
def test_texts_without_metrics(text):
    assert measure(text) is None


def test_skeleton():
    out = skeleton(MODULE)
    tree = ast.parse(out)
    assert "# body-sha256: " in out and "'body-sha256" not in out
    names = {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    assert names == {"plain", "method", "later", "nested_in_if"}
    assert all(isinstance(n.body[0], ast.Pass) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef))
    assert "inner" not in out and "@property" in out
    assert "sha256" not in skeleton(MODULE, anchors=False)
    assert skeleton("def (") is None and skeleton("") == ""


def test_skeleton_keeps_strings_that_look_like_its_comments():
    own = f'"body-sha256: {"0" * 64}"'
    out = skeleton(f"class A:\n    {own}\n\ndef f():\n    {own}\n    return 1\n")
    assert f"{'0' * 64}" in ast.parse(out).body[0].body[0].value.value and out.count("# body-sha256: ") == 1


def test_python_rows(make_files):
    files = make_files({"m.py": MODULE, "bad.py": "def (", "e.py": "", "w.py": " \n", "n.txt": MODULE, "C.PY": "class A:\n    def m(self):\n        pass\n"})
    parsed = pymetrics.parsed_files(files)
    assert {r.path for r in parsed.collect()} == {"m.py", "C.PY"}
    metrics = {r.path: r for r in pymetrics.file_metrics(parsed).collect()}
    assert (metrics["m.py"].function_count, metrics["m.py"].total_complexity) == (3, 21)
    assert metrics["C.PY"].function_count == 0 and metrics["C.PY"].average_complexity == 0.0
    repo = pymetrics.repo_complexity(pymetrics.file_metrics(parsed)).first()
    assert (repo.total_functions_found, repo.average_cyclomatic_complexity) == (3, 7.0)
    top = pymetrics.top_complex_functions(pymetrics.function_metrics(parsed), 2).orderBy("rank").collect()
    assert [r.function_name for r in top] == ["plain", "later"]


def test_distill_levels(make_files):
    files = make_files({
        "s.py": 'x = "a#b"\n"""doc # text"""\n\n\n\ny = 1\n', "block.js": "'''\nabc\n'''\nz # c\n", "gone.md": "# only\n",
        "gen.md": "x # -- generated by srcframe -- y\nrest", "nul.md": "a\0", "m.py": "def f():\n    return 1\n", "bad.py": "def (: # c",
        "data.json": "{}", "late.md": "x\n# -- generated by srcframe --\ny",
    })
    def texts(level):
        return {r.path: r.distilled for r in distill.distilled(distill.distill_inputs(files), level).collect()}

    one = texts(1)
    assert one == {
        "s.py": 'x = "a\n"""doc \n\ny = 1', "block.js": "'''...'''\nz", "m.py": "def f():\n    return 1", "bad.py": "def (:", "late.md": "x\n\ny"}
    two = texts(2)
    assert two["m.py"].endswith("def f():\n    pass") and two["bad.py"] == "def (:" and two["block.js"] == one["block.js"]
    with pytest.raises(ValueError):
        distill.distilled(files, 3)


def test_line_ranges_point_into_the_written_text(make_files, tmp_path):
    from srcframe.plans import jobs
    from srcframe.sources import sinks

    files = make_files({"b/x.py": "def f():\n    return 1\n", "a.md": "one\ntwo", "c.sh": "echo"})
    done = jobs.distill(files, level=1)
    folder = str(tmp_path / "out")
    sinks.write_distilled(distill.distilled_blocks(done.texts), folder)
    parts = sorted((tmp_path / "out" / "repo=r").glob("part-*.txt"))
    written = "".join(p.read_text() for p in parts).split("\n")
    texts = {r.path: r.distilled for r in done.texts.collect()}
    for r in done.ranges.collect():
        assert "\n".join(written[r.output_first_line - 1:r.output_last_line]) == texts[r.path]
        assert (r.first_line, r.last_line) == (r.output_first_line - 2, r.output_last_line - 2)
    assert written[0] == "# -- generated by srcframe --" and written[1] == ""
    sinks.write_distill_map(done.ranges, str(tmp_path / "map"), 1)
    assert len(list((tmp_path / "map" / "repo=r").glob("part-*.txt"))) >= 1

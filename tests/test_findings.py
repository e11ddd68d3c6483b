import random

import pytest

from srcframe.operators import deps, findings, secrets

def requirement_file(rng):
    """Lines put together from known parts, and the names that they declare."""
    lines, names = [], []
    for _ in range(rng.randint(0, 9)):
        name = "".join(rng.choices("abcxyz0._-", k=rng.randint(1, 8)))
        kind = rng.randrange(6)
        if kind == 0:
            lines.append(rng.choice(["", "  ", "\t", "# " + name, "   #" + name]))
            continue
        extra = rng.choice(["", "[" + name + "]", "#" + name, ";"])  # part of the name
        after = rng.choice(["", "=1", "<2", ">=3,<4", "~=5", "!=6", " # note", "  #", " == 7"])
        lines.append(rng.choice(["", " ", "\t "]) + name + extra + after + rng.choice(["", " ", "\t"]))
        hash_at = 1 + len(name) if extra.startswith("#") else 0
        # a hash after a letter, a digit or an underscore belongs to the name
        names.append(name if hash_at and not (name[-1].isalnum() or name[-1] == "_") else name + extra)
    return "\n".join(lines), names


def test_requirements(make_files):
    rng = random.Random(12)
    made = [requirement_file(rng) for _ in range(120)]
    files = make_files([(str(i), "requirements.txt", text) for i, (text, _) in enumerate(made)] + [("nested", "sub/requirements.txt", "x")])
    got = {r.repo: r.deps for r in deps.dependency_lists(files).collect()}
    assert got == {str(i): names for i, (_, names) in enumerate(made) if names}
    odd = make_files({"requirements.txt": "-r more.txt\n!x\n==y\n"})
    assert [r.deps for r in deps.dependency_lists(odd).collect()] == [["-r"]]


def test_manifests(make_files):
    files = make_files([
        ("a", "package.json", '{"dependencies": {"x": "1", "y": "2"}, "devDependencies": {"x": "1", "z": "3"}}'),
        ("b", "package.json", '{"dependencies": null, "devDependencies": {"d": "1"}}'),
        ("c", "package.json", '{"dependencies": {"x": "1"}'), ("d", "package.json", "[1]"), ("e", "package.json", "{}"),
        ("f", "package.json", '{"dependencies": {"x": "1"}} more'), ("g", "package.json", "{'dependencies': {'x': '1'}}"),
        ("h", "package.json", '{"dependencies": {"x": "1"}}, {}'), ("i", "package.json", '{}], "w": [{"dependencies": {}}'),
        ("a", "pyproject.toml", '[project]\ndependencies = ["q>=1", "r"]\n[tool.poetry.dependencies]\npython = "^3"\ns = "*"\n'),
        ("b", "pyproject.toml", "[project"), ("c", "pyproject.toml", "[project]\nname = 'x'\n"), ("d", "pyproject.toml", "project = 3"),
    ])
    lists = deps.dependency_lists(files)
    got = {r.repo: r.dependency_files_found for r in deps.dependency_map(lists).collect()}
    assert got == {
        "a": {"package.json": ["x", "y", "x", "z"], "pyproject.toml": ["q>=1", "r", "python", "s"]},
        "b": {"package.json": ["d"]},
    }
    rows = deps.dependencies(lists).where("repo = 'a' and manifest = 'package.json'").orderBy("pos").collect()
    assert [(r.pos, r.dep) for r in rows] == [(0, "x"), (1, "y"), (2, "x"), (3, "z")]


SECRET_LINES = [
    ("AKIA" + "A1" * 8, "aws_access_key_id"), ("AKIA123", None),
    ("ghp_" + "a" * 36, "github_token"), ("ghp_short", None),
    ("xoxb-" + "1" * 12, "slack_token"), ("xoxz-" + "1" * 12, None),
    ("AIza" + "b" * 35, "google_api_key"), ("AIza", None),
    ("-----BEGIN EC PRIVATE KEY-----", "private_key"), ("-----BEGIN PUBLIC KEY-----", None),
    ("eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh12", "jwt"), ("eyJx.eyJ.z", None),
    ("Password: 'hunter2hunter2'", "assigned_secret"), ("password = hunter2", None),
]


def test_secret_rules(make_files):
    files = make_files({"a/.env": "\n".join(line for line, _ in SECRET_LINES)})
    rows = sorted(secrets.find_secrets(files).collect(), key=lambda r: r.line_number)
    assert [(r.line_number, r.secret_type) for r in rows] == [
        (i + 1, kind) for i, (_, kind) in enumerate(SECRET_LINES) if kind]
    assert all("****" in r.line_content for r in rows)
    assert not any(len(r.line_content) > 40 for r in rows)


def test_no_row_shows_another_rule_s_value(make_files):
    key, token = "AKIA" + "B2" * 8, "xoxb-" + "9" * 12
    rows = secrets.find_secrets(make_files({"x": f"  {key} and {token} \n"})).collect()
    assert sorted(r.secret_type for r in rows) == ["aws_access_key_id", "slack_token"]
    assert all(r.line_content == "**** and ****" for r in rows)


@pytest.mark.parametrize("text", ["{", "", "[]", '{"results": []}', '{"results": [{}]}', "null"])
def test_scanner_documents_without_rows(spark, text):
    df = spark.createDataFrame([("r", text)], "repo string, json string")
    assert findings.parse_dependency_scan(df).count() == 0
    if text != '{"results": [{}]}':
        assert findings.parse_code_scan(df).count() == 0


def test_scanner_defaults(spark):
    dep = '{"results": [{"packages": [{"vulnerabilities": [{"id": "V1"}, {"summary": "s", "database_specific": {"severity": "LOW"}}]}]}]}'
    code = '{"results": [{}, {"check_id": "c", "path": "p", "start": {"line": 7}, "extra": {"message": "m", "severity": "ERROR"}}]}'
    d = findings.parse_dependency_scan(spark.createDataFrame([("r", dep)], "repo string, json string"))
    assert [tuple(r) for r in d.collect()] == [
        ("r", "V1", "unknown", "unknown", "", None), ("r", "", "unknown", "unknown", "s", "LOW")]
    c = findings.parse_code_scan(spark.createDataFrame([("r", code)], "repo string, json string"))
    assert [tuple(r) for r in c.collect()] == [("r", "", "", 0, "", "INFO"), ("r", "c", "p", 7, "m", "ERROR")]
    none = spark.createDataFrame([], "repo string, file_path string, secret_type string, line_number int, line_content string")
    summary = findings.finding_summary(findings.threat_assessment(d, c, none)).first()
    assert tuple(summary) == ("r", 2, 2, 0, True)


def test_a_document_is_parsed_once(spark):
    rows = [
        ("a", '{"results": [{"packages": [{"package": {"name": "n"}, "vulnerabilities": [{"id": "V"}]}], "check_id": "c"}]}'),
        ("b", '{"results": []} []'), ("c", None), ("d", "null"), ("e", '{"results": []'), ("f", '{}, {"_end_of_text": true}')]
    scans = spark.createDataFrame(rows, "repo string, json string")
    for parse in (findings.parse_dependency_scan, findings.parse_code_scan):
        found = parse(scans)
        assert found._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
        assert [r.repo for r in found.collect()] == ["a"]


def test_project_files_are_read_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    made = ['[project]\ndependencies = ["n%d%s"]\n' % (i, "x" * 20_000) for i in range(2_000)]
    batch = pa.array([*made, None, "[project"])
    tracemalloc.start()
    (found,) = deps._toml_names.func(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the batch holds 40 MB of texts, and as many of names
    assert peak < 4 * deps.PIECE_CHARS
    assert len(found) == 2_002 and found[1_999].as_py() == ["n1999" + "x" * 20_000] and found[2_000].as_py() == found[2_001].as_py() == []

import json
import os

import pytest
from pyspark.sql import functions as F

from srcframe.operators import report
from srcframe.plans import jobs
from srcframe.sources import filesystem, sinks
from srcframe.streaming import incremental


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "proj"
    for path, data in {
        "__init__.py": b"x = 1\n", "_p.py": b"", ".gitignore": b"*.log\n", "a.log": b"l", "src/.hid/deep.py": b"d",
        "src/main.py": b"def f(a):\r\n    return a\r\n", "bad.txt": b"ok \xff\xfe end", "node_modules/x.js": b"1",
        "requirements.txt": b"numpy>=1\n", "src/one/two/three/four.md": b"# t\n",
    }.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(data)
    (base / "empty").mkdir()
    os.symlink(base / "bad.txt", base / "link.txt")
    os.symlink(base / "src", base / "linked_dir")
    return str(base)


def test_listing_and_reading(spark, root):
    for parts in (1, 4, 64):
        listing = filesystem.list_repos(spark, [root], partitions=parts).collect()
        assert {r.path for r in listing if r.is_dir} == {"src", "src/.hid", "src/one", "src/one/two", "src/one/two/three", "empty"}
        assert {r.path for r in listing if r.is_symlink} == {"link.txt", "linked_dir"}
        assert len({r.path for r in listing}) == len(listing)
    files = {r.path: r for r in filesystem.scan_repos(spark, [root]).collect()}
    assert set(files) == {
        "__init__.py", "_p.py", ".gitignore", "a.log", "src/.hid/deep.py", "src/main.py", "bad.txt",
        "requirements.txt", "src/one/two/three/four.md"}
    assert files["bad.txt"].content == "ok  end" and files["bad.txt"].disk_size == 9
    assert files["src/main.py"].content == "def f(a):\n    return a\n" and files["src/main.py"].repo == "proj"
    visible = filesystem.list_repos(spark, {"n": root}, enter_hidden=False, skip_dirs=["one"])
    assert {r.path for r in visible.collect() if not r.is_dir and not r.is_symlink} == {
        "__init__.py", "_p.py", ".gitignore", "a.log", "src/main.py", "bad.txt", "node_modules/x.js", "requirements.txt"}


def test_bad_roots(spark, root):
    with pytest.raises(Exception, match="FileNotFoundError|No such|missing"):
        filesystem.list_repos(spark, [root + "/missing"]).collect()
    with pytest.raises(Exception, match="NotADirectory"):
        filesystem.list_repos(spark, [root + "/bad.txt"]).collect()


def test_a_deep_chain_is_walked_in_few_rounds(spark, tmp_path, monkeypatch):
    depth, at = 3_000, os.open(tmp_path, os.O_RDONLY)  # paths of 6,000 bytes, more than a system call takes
    for _ in range(depth):
        os.mkdir("d", dir_fd=at)
        below = os.open("d", os.O_RDONLY, dir_fd=at)
        os.close(at)
        at = below
    with os.fdopen(os.open("last.py", os.O_WRONLY | os.O_CREAT, dir_fd=at), "w") as handle:
        handle.write("x = 1\n")
    os.close(at)
    rounds, stored = [], filesystem.materialize
    monkeypatch.setattr(filesystem, "materialize", lambda df: rounds.append(1) or stored(df))
    listing = filesystem.list_repos(spark, {"deep": str(tmp_path)}, partitions=2)
    assert listing.where("is_dir").count() == depth and len(rounds) == 3
    (read,) = filesystem.read_contents(listing, 2).select("content", F.length("path").alias("n")).collect()
    assert read.content == "x = 1\n" and read.n == 2 * depth + len("last.py")


def test_many_roots_in_a_table(spark, tmp_path, monkeypatch):
    for i in range(600):
        (tmp_path / f"r{i}" / "a" / "b").mkdir(parents=True)
        (tmp_path / f"r{i}" / "a" / "b" / "x.py").write_text("")
    roots = spark.range(600).select(
        F.format_string("n%d", "id").alias("repo"), F.format_string(f"{tmp_path}/r%d", "id").alias("root"))
    monkeypatch.setattr(filesystem, "FIRST_SHARE", 7)  # less than a task's share of the roots
    listing = filesystem.list_repos(spark, roots, partitions=4)
    assert listing.where("path = 'a/b/x.py' and not is_dir").select("repo").distinct().count() == 600
    assert listing.count() == 1800
    with pytest.raises(ValueError):
        filesystem.list_repos(spark, roots.union(roots.limit(1)))


def test_scan_job(spark, root, tmp_path):
    files = filesystem.scan_repos(spark, [root])
    dirs = filesystem.list_repos(spark, [root], enter_hidden=False).where("is_dir").select("repo", "path")
    reports = report.report_json(jobs.scan(files, empty_dirs=dirs))
    sinks.write_report(reports, str(tmp_path / "out"))
    written = list((tmp_path / "out" / "repo=proj").glob("part-*.txt"))
    data = json.loads("".join(p.read_text() for p in written))
    assert list(data) == [
        "analysis_metadata", "repository_summary", "directory_tree", "key_files", "code_insights", "dependency_info", "threat_assessment"]
    summary = data["repository_summary"]
    assert summary["total_files"] == 6 and summary["primary_language"] == "Python"
    assert summary["language_stats"] == {"Markdown": 1, "Python": 3}
    assert summary["total_functions_found"] == 1
    assert [n["name"] for n in data["directory_tree"]] == ["empty", "src", "__init__.py", "_p.py", "bad.txt", "requirements.txt"]
    assert data["dependency_info"]["dependency_files_found"] == {"requirements.txt": ["numpy"]}
    assert data["key_files"]["important_files_detected"] == ["requirements.txt", "src/main.py"]
    assert data["code_insights"]["top_complex_functions"][0]["function_name"] == "f"


def test_pack_and_audit_jobs(spark, make_files, tmp_path):
    files = make_files({"a.txt": "one two", ".hid/k.txt": "xoxb-" + "1" * 12, "b.md": "three\n"})
    packed = jobs.pack(files, budget=200)
    sinks.write_pack(packed.texts, str(tmp_path / "raw"))
    sinks.write_pack(packed.texts, str(tmp_path / "json"), "json")
    raw = "".join(p.read_text() for p in sorted((tmp_path / "raw" / "repo=r").glob("part-*.txt")))
    assert raw.startswith("# -- generated by srcframe --\n\n=====") and raw.index("b.md") < raw.index("a.txt")
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name / "repo=r").glob("part-*.txt")))
    data = json.loads(read("json"))
    assert [f["path"] for f in data["files"]] == ["b.md", "a.txt"]
    sinks.write_pack(packed.texts, str(tmp_path / "raw2"), keys=packed.selected)
    sinks.write_pack(packed.texts, str(tmp_path / "json2"), "json", keys=packed.selected)
    assert read("raw2") == raw and json.loads(read("json2"))["files"] == data["files"]
    with pytest.raises(ValueError, match="no file can be packed"):
        jobs.pack(files, budget=10)
    empty = spark.createDataFrame([], "repo string, json string")
    audited = jobs.audit(files, empty, empty)
    assert [(r.kind, r.file_path) for r in audited.findings.collect()] == [("secret", ".hid/k.txt")]
    assert audited.summary.first().has_findings


def test_store_is_updated_only_with_changes(spark, make_files, tmp_path):
    store = str(tmp_path / "store")
    day1 = {"same.py": "x = 1\n", "changed.py": "y = 1\n", "removed.py": "z = 1\n", "bad.py": "def (", "other.bin": "q"}
    day2 = {"same.py": "x = 1\n", "changed.py": "y = 1\ny = 2\n", "added.sh": "# c\n", "bad.py": "def (", "other.bin": "q"}
    incremental.update_store(make_files(day1), store, 1)
    incremental.update_store(make_files(day2), store, 2)
    incremental.update_store(make_files(day2), store, 3)
    rows = spark.read.parquet(store).collect()
    assert sorted((r.path, r.version) for r in rows) == [
        ("added.sh", 2), ("bad.py", 1), ("changed.py", 1), ("changed.py", 2), ("other.bin", 1), ("removed.py", 1), ("same.py", 1)]

    def current(files):
        found = incremental.current_results(incremental.file_versions(files), spark.read.parquet(store))
        return {r.path: r.code for r in found.collect()}

    assert current(make_files(day2)) == {"added.sh": 0, "bad.py": 1, "changed.py": 2, "other.bin": None, "same.py": 1}
    # Back to the first texts: nothing is analysed anew, and the old results hold.
    incremental.update_store(make_files(day1), store, 4, states=str(tmp_path / "states"))
    assert spark.read.parquet(store).count() == len(rows)
    assert current(make_files(day1))["changed.py"] == 1
    incremental.update_store(make_files({"changed.py": "y = 1\ny = 2\n"}), store, 5, states=str(tmp_path / "states"))
    latest = incremental.latest_versions(spark.read.parquet(str(tmp_path / "states")))
    assert {r.path: r.code for r in incremental.current_results(latest, spark.read.parquet(store)).collect()}["changed.py"] == 2


def removable(make_files, spark, content, removed=()):
    files = make_files(content | {p: "" for p in removed})
    return files.withColumn("removed", files.path.isin(list(removed)) if removed else files.path.isNull())


def test_stream(spark, make_files, tmp_path):
    """Restarts, a text that comes back, a removal, and one hash of each text."""
    from pyspark.sql import functions as F

    incoming, store, states = (str(tmp_path / n) for n in ("in", "store", "states"))
    days = [
        ({"a.py": "x = 1\n", "b.sh": "echo\n", "c.py": "z = 0\n"}, ()),
        ({"a.py": "x = 1\n", "b.sh": "echo 2\n"}, ()),
        ({"b.sh": "echo\n"}, ("c.py",)),  # back to the first text
    ]
    for content, removed in days:
        removable(make_files, spark, content, removed).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(removable(make_files, spark, {}, ("x",)).schema).parquet(incoming)
        query = incremental.start_stream(stream, store, str(tmp_path / "cp"), states=states)
        assert query.awaitTermination(120)
        progress = query.lastProgress
        # a micro-batch updates the state of its own files only
        assert progress["stateOperators"][0]["numRowsUpdated"] <= len(content) + len(removed)
    rows = spark.read.parquet(store).collect()
    assert sorted((r.path, r.code, r.version) for r in rows) == [("a.py", 1, 0), ("b.sh", 1, 0), ("b.sh", 1, 1), ("c.py", 1, 0)]
    latest = incremental.latest_versions(spark.read.parquet(states))
    sha = {r.path: r.content_hash for r in latest.collect()}
    assert set(sha) == {"a.py", "b.sh"}
    now = make_files({"a.py": "x = 1\n", "b.sh": "echo\n"})
    assert sha == {r.path: r.content_hash for r in incremental.file_versions(now).collect()}
    assert {r.path: r.version for r in incremental.current_results(latest, spark.read.parquet(store)).collect()} == {"a.py": 0, "b.sh": 0}
    marked = incremental.seen_in_state(spark.readStream.schema(removable(make_files, spark, {}, ("x",)).schema).parquet(incoming))
    analysed = incremental.analyse(spark.createDataFrame([], marked.schema))
    assert "sha2" not in analysed._jdf.queryExecution().optimizedPlan().toString()


def test_the_store_side_is_not_shuffled(spark, make_files, tmp_path):
    folder = str(tmp_path / "store")
    files = make_files({f"f{i}.py": f"x = {i}\n" for i in range(40)})
    store = incremental.update_store(files, folder, 1)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        for made, rows in ((incremental.unseen_versions(files, store), 0), (incremental.stored_results(files, store), 40)):
            assert made.count() == rows
            plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            # the one shuffle is of the files' keys
            below = plan[plan.index("Exchange hashpartitioning"):]
            assert "sha2" in below.split("FileScan")[0]
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_scan_reuses_stored_facts(spark, make_files, tmp_path):
    day1 = {"a.py": "def f(a):\n    return a\n", "b.md": "# TODO x\n", "c.sh": "echo\n"}
    day2 = day1 | {"b.md": "# TODO x TODO\n", "d.py": "y = 2\n"}
    folder = str(tmp_path / "facts")
    text = lambda sections: sorted(
        (r.repo, r.key, r.text) for r in report.report_json(sections).collect() if r.key != "a")
    for run, day in enumerate((day1, day2, day1)):
        files = make_files(day)
        assert text(jobs.scan(files, store=folder, run=run)) == text(jobs.scan(files))
    rows = spark.read.parquet(folder).collect()
    assert sorted((r.path, r.version) for r in rows) == [("a.py", 0), ("b.md", 0), ("b.md", 1), ("c.sh", 0), ("d.py", 1)]


def test_options_of_a_repository_count_in_pack_and_distill(spark, make_files):
    files = make_files({"keep.md": "one two\n", "gen/x.md": "three\n", "n.txt": "four\n", ".hid/h.md": "five\n"})
    own = spark.createDataFrame([("r", ["gen"], ["*.txt"])], "repo string, exclude_dirs array<string>, exclude_patterns array<string>")
    assert {r.path for r in jobs.pack(files, own_options=own, include_hidden=True).selected.collect()} == {"keep.md", ".hid/h.md"}
    assert {r.path for r in jobs.pack(files, exclude_dirs=["gen"]).selected.collect()} == {"keep.md", "n.txt"}
    assert {r.path for r in jobs.distill(files, 1, own_options=own).texts.collect()} == {"keep.md"}


def test_each_text_is_made_once_for_the_writers(spark, make_files, tmp_path):
    from pyspark.sql import functions as F

    from srcframe.operators import distill

    files = make_files([("big", f"d{i % 7}/f{i:04d}.md", f"text {i}") for i in range(300)] + [("small", "a.md", "x")])
    done = jobs.distill(files, 1)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(block):
        calls.add(1)
        return block

    blocks = distill.distilled_blocks(done.texts).withColumn("block", counted.asNondeterministic()("block"))
    sinks.write_distilled(blocks, str(tmp_path / "out"), keys=done.keys)
    assert calls.value == 301
    assert len(list((tmp_path / "out" / "repo=big").glob("part-*.txt"))) > 1
    packed = jobs.pack(files)
    texts = packed.texts.withColumn("content", counted("content"))
    for fmt, n in (("raw", 602), ("json", 903)):
        sinks.write_pack(texts, str(tmp_path / fmt), fmt, keys=packed.selected)
        assert calls.value == n


def test_a_large_text_is_written_by_many_tasks_in_order(spark, make_files, tmp_path):
    from srcframe.operators import distill

    rows = [("big", f"d{i % 7}/f{i:04d}.md", f"text {i}") for i in range(400)] + [("small", "a.md", "x")]
    texts = distill.distilled(distill.distill_inputs(make_files(rows)), 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_distilled(distill.distilled_blocks(texts), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "out" / "repo=big").glob("part-*.txt"))
    assert len(parts) > 1
    written = "".join(p.read_text() for p in parts)
    rule = "=" * 50
    blocks = [f"{rule}\n--- FILE: {p} ---\n{rule}\n{t}\n\n" for _, p, t in sorted(rows) if p != "a.md"]
    assert written == "# -- generated by srcframe --\n\n" + "\n".join(blocks) + "\n"
    ranges = {r.path: r for r in distill.line_ranges(texts).collect() if r.repo == "big"}
    lines = written.split("\n")
    for _, path, text in rows[:400]:
        assert lines[ranges[path].output_first_line - 1] == text


def test_rows_of_parquet_files_without_whole_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    made = pa.table({"n": range(700), "text": ["t" * (i % 90) for i in range(700)]})
    (tmp_path / "many").mkdir()
    pq.write_table(made, tmp_path / "many" / "a.parquet", row_group_size=100)
    pq.write_table(made.slice(0, 0), tmp_path / "none.parquet")
    pq.write_table(made, tmp_path / "one.parquet")
    (tmp_path / "link.parquet").symlink_to(tmp_path / "one.parquet")
    listing = filesystem.list_repos(spark, {"r": str(tmp_path)})
    found = filesystem.parquet_rows(listing)
    assert {r.path: r.n_rows for r in found.collect()} == {"many/a.parquet": 700, "none.parquet": 0, "one.parquet": 700}
    assert "bytes" not in found._jdf.queryExecution().optimizedPlan().toString()

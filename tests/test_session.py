from pyspark.sql import functions as F

from srcframe.session import broadcast_if_small, compute_once, measured_bytes


def test_broadcast_only_below_the_bound(spark):
    small = spark.range(1000).select(F.col("id"), F.repeat(F.lit("x"), 100).alias("t"))
    assert 100_000 < measured_bytes(small) < 150_000
    assert measured_bytes(small.limit(0)) == 0

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower() or "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(broadcast_if_small(small))
    assert not hinted(broadcast_if_small(small, limit=1000))


def test_results_do_not_depend_on_the_join_used(spark, make_files, monkeypatch):
    """Without broadcasts of rows the same rows come, and no text is shuffled at all."""
    from srcframe import session
    from srcframe.functions.lfs import LFS_SPEC_LINE
    from srcframe.operators import ignore, options

    pointer = f"{LFS_SPEC_LINE}\nsize 77\n"
    files = make_files([
        ("a", ".gitignore", "*.x\nd/"), ("a", "1.x", ""), ("a", "k", "text"), ("a", "d/e/f", ""), ("b", "1.x", ""),
        ("a", ".gitattributes", "*.bin filter=lfs"), ("a", "p.bin", pointer), ("a", "q.bin", "no"), ("b", "p.bin", pointer)])
    config = spark.createDataFrame([("a", ["d"], ["k*"])], "repo string, exclude_dirs array<string>, exclude_patterns array<string>")
    forms = [ignore.apply_gitignore, ignore.with_lfs, lambda f: options.apply_exclusions(f, config)]
    rows = lambda df: sorted(map(str, df.collect()))
    want = [rows(form(files)) for form in forms]
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        for form, before in zip(forms, want):
            made = form(files)
            assert rows(made) == before
            plan = made._jdf.queryExecution().executedPlan().toString()
            # the decisions come back as bitsets
            assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan, plan
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_sizes_of_binary_columns_are_counted(spark):
    import pytest

    df = spark.range(2).select(F.repeat(F.lit("x"), 50_000).cast("binary").alias("b"))
    assert measured_bytes(df) > 100_000
    with pytest.raises(TypeError):
        measured_bytes(spark.range(1).select(F.make_dt_interval().alias("d")))


def test_a_filter_stays_above_a_costly_column(spark):
    df = spark.range(10).select(F.concat(F.lit("a"), "id").alias("t"))
    plan = compute_once(df, n=F.regexp_count("t", F.lit("[a-c]+"))).where("n > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("regexp_count") == 1

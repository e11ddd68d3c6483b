"""Ignore-file rules and large-file attribute rules, per repository.

All rules of a repository become one regular expression. A path is then tested once,
whatever the number of rules, inside the scan: files are not shuffled. Spark keeps the
compiled expression while consecutive rows share it, so it is compiled per repository
and not per row.

Where the rules of all repositories are too many for a broadcast, narrow keys meet them:
every directory and every file name is tested once. An ignored directory is an interval of
walk keys, and one sweep over the sorted keys tells which files lie in one, so decisions
grow with the ignored directories and not with the files and their ancestors. The dropped
keys go back to the scan as bitsets (:mod:`srcframe.operators.membership`); texts stay there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.constants import WHITE_SPACE
from srcframe.functions import lines, paths
from srcframe.functions.globs import ignore_regex_col, shell_regex_col
from srcframe.functions.lfs import pointer_size
from srcframe.operators.membership import cascade, drop_members
from srcframe.operators.ordering import running_total
from srcframe.session import broadcast_if_small, compute_once, fits_broadcast, materialize

# Appended to every tested path. A drop rule consumes the first letter, a keep rule
# both, so the end of the match tells which kind of rule it was.
_PROBE = "\u0000dk"


def ignore_rules(files: DataFrame) -> DataFrame:
    """(repo, rule_no, regex, negated) from the ``.gitignore`` at each root."""
    found = files.where(F.col("path") == ".gitignore")
    lines_ = compute_once(found, _lines=lines.split_lines(F.col("content"))).select(
        "repo", F.posexplode("_lines").alias("rule_no", "line")
    )
    return (
        lines_.withColumn("rule", ignore_regex_col("line"))
        .where(F.col("rule.regex").isNotNull())
        .select("repo", "rule_no", "rule.regex", "rule.negated")
    )


def combined_rules(rules: DataFrame) -> DataFrame:
    """(repo, matcher): alternatives with the last rule first, as the last match wins."""
    option = F.concat(
        F.lit("(?:"), "regex", F.lit(")\\x00d"), F.when(F.col("negated"), F.lit("k")).otherwise("")
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("rule_no")).alias("n"), option.alias("o"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["o"]), "|")
    return rules.groupBy("repo").agg(
        F.concat(F.lit("(?s)\\A(?:"), joined, F.lit(")")).alias("matcher")
    )


def _dropped(path: Column, matcher: Column) -> Column:
    hit = F.regexp_substr(F.concat(path, F.lit(_PROBE)), matcher)
    return F.coalesce(hit.endswith("d"), F.lit(False))


def is_ignored(path: Column, matcher: Column) -> Column:
    """The file is ignored itself, or lies below an ignored directory."""
    folders = F.transform(paths.ancestors(paths.parent_dir(path)), lambda d: F.concat(d, F.lit("/")))
    below = F.exists(folders, lambda d: _dropped(d, matcher))
    return matcher.isNotNull() & (_dropped(path, matcher) | below)


def apply_gitignore(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Drop ignored files. ``rules`` defaults to those found in ``files`` itself."""
    matchers = materialize(combined_rules(ignore_rules(files) if rules is None else rules))
    ignored = is_ignored(F.col("path"), F.col("matcher"))
    if fits_broadcast(matchers):
        return files.join(F.broadcast(matchers), "repo", "left").where(~ignored).select(*files.columns)
    return drop_members(files, ignored_files(files, matchers), ["repo", "path"])


def ignored_intervals(files: DataFrame, matchers: DataFrame) -> DataFrame:
    """(repo, low, high): the walk keys below every ignored directory. ``high`` is excluded."""
    # directories are far fewer than files; each is expanded and tested once
    direct = files.select("repo", paths.parent_dir(F.col("path")).alias("dir")).distinct()
    folders = direct.select("repo", F.explode(paths.ancestors(F.col("dir"))).alias("dir")).distinct()
    tested = folders.join(broadcast_if_small(matchers), "repo").where(
        _dropped(F.concat("dir", F.lit("/")), F.col("matcher")))
    low = paths.dir_walk_key(F.col("dir"))
    # the key of a directory ends in NUL; all keys below go on with '0' or '1'
    return tested.select("repo", low.alias("low"), F.concat(low, F.lit("2")).alias("high"))


def in_intervals(keys: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows of ``keys (repo, walk_key, ...)`` that lie in an interval of their repository.

    One sweep over the sorted keys: an interval counts from its low to its high end. The sum
    is taken over range partitions, so no task sees a whole repository or a whole interval.
    """
    edge = lambda c, value: intervals.select(
        "repo", F.col(c).alias("walk_key"), F.lit(None).cast("string").alias("path"), F.lit(value).alias("_edge"))
    rows = keys.select("repo", "walk_key", "path", F.lit(0).alias("_edge")).unionByName(edge("low", 1)).unionByName(edge("high", -1))
    # equal edges are told apart by their number, so the order is one
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    swept = running_total(numbered, ["repo"], ["walk_key", "_row"], F.col("_edge"), "_open", costly_input=True)
    return swept.where(F.col("path").isNotNull() & (F.col("_open") > 0)).select("repo", "path")


def ignored_files(files: DataFrame, matchers: DataFrame) -> DataFrame:
    """(repo, path) of the ignored files, found with narrow keys alone."""
    keys = files.select("repo", "path", "walk_key")
    by_name = keys.join(broadcast_if_small(matchers), "repo").where(_dropped(F.col("path"), F.col("matcher"))).select("repo", "path")
    return by_name.unionByName(in_intervals(keys, ignored_intervals(files, matchers))).distinct()


def lfs_patterns(files: DataFrame) -> DataFrame:
    """(repo, pos, pattern) from the ``.gitattributes`` at each root."""
    parsed = files.where(F.col("path") == ".gitattributes").select(
        "repo", F.posexplode(F.split("content", "\n")).alias("pos", "raw")
    ).select("repo", "pos", lines.strip(F.col("raw")).alias("line"))
    is_rule = ~F.col("line").startswith("#") & F.col("line").contains("filter=lfs")
    return parsed.where(is_rule).select(
        "repo", "pos", F.regexp_extract("line", f"^[^{WHITE_SPACE}]+", 0).alias("pattern")
    )


# Longest literal end of a glob that serves as its key.
_END = 12


def managed_paths(pointers: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo, path) of the ``pointers`` that one of the ``patterns (repo, pattern)`` matches.

    Globs are indexed by the letters after their last wildcard. A path meets those of its
    repository that end as it does, and only these are tested as expressions.
    """
    end = F.regexp_extract("pattern", r"[^*?\[\]]*\z", 0)
    globs = patterns.select("repo", "pattern").distinct().select(
        "repo", F.substring(end, F.greatest(F.lit(1), F.length(end) - _END + 1), F.lit(_END)).alias("end"),
        shell_regex_col("pattern").alias("regex"))
    globs = materialize(globs.withColumn("size", F.length("end")))
    ends = F.transform(F.sequence(F.lit(0), F.least(F.lit(_END), F.length("path"))), lambda n: F.struct(
        n.alias("size"), F.when(n == 0, F.lit("")).otherwise(F.substring("path", F.length("path") - n + 1, n)).alias("end")))
    # only lengths that some glob has
    lengths = sorted(r["size"] for r in globs.select("size").distinct().collect())  # at most _END + 1
    wanted = F.filter(ends, lambda e: e["size"].isin(lengths or [-1]))
    places = pointers.select("repo", "path", F.inline(wanted))
    met = places.join(broadcast_if_small(globs), ["repo", "size", "end"])
    return met.where(F.rlike("path", F.col("regex"))).select("repo", "path").distinct()


def with_lfs(files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Fill the pointer columns: files under a pattern whose text is a pointer.

    The pattern is matched against the whole path, and ``*`` crosses slashes.
    ``patterns`` defaults to those found in ``files`` itself.
    """
    found = lfs_patterns(files) if patterns is None else patterns
    option = F.concat(F.lit("(?:"), shell_regex_col("pattern"), F.lit(")"))
    matchers = materialize(
        found.select("repo", option.alias("option")).groupBy("repo").agg(
            F.array_join(F.array_sort(F.collect_set("option")), "|").alias("_matcher")
        )
    )
    size = pointer_size(F.col("content"))
    plain = files.drop("is_lfs_pointer", "real_size", "size_bytes")
    # regexp_instr keeps the compiled expression between rows of one repository.
    managed = F.coalesce(F.regexp_instr(F.col("path"), F.col("_matcher")) > 0, F.lit(False))
    if fits_broadcast(matchers):
        sized = plain.join(F.broadcast(matchers), "repo", "left").withColumn(
            "real_size", F.when(size.isNotNull(), F.when(managed, size)))
    else:
        # Pointer texts are few; which of them are managed goes back to the scan as bitsets.
        pointers = materialize(files.where(size.isNotNull()).select("repo", "path"))
        free = materialize(pointers.join(managed_paths(pointers, found), ["repo", "path"], "left_anti"))
        held = cascade(pointers.join(free, ["repo", "path"], "left_anti"), free, ["repo", "path"])
        if held is None:
            marks = pointers.join(free, ["repo", "path"], "left_anti").withColumn("_managed", F.lit(True))
            sized = plain.join(marks, ["repo", "path"], "left")
        else:
            sized = held.member(plain, "_managed")
        sized = sized.withColumn("real_size", F.when(size.isNotNull() & F.coalesce("_managed", F.lit(False)), size))
    marked = (
        sized
        .withColumn("is_lfs_pointer", F.col("real_size").isNotNull())
        .withColumn("size_bytes", F.coalesce("real_size", "disk_size"))
    )
    return marked.select(*files.columns)

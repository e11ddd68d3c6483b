"""The most valuable texts of each repository under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcframe.constants import (
    GENERATED_MARKER, PACK_MAX_FILE_KB, PACK_RULE, PACK_TOKEN_BUDGET, TIMESTAMP_FORMAT,
    TOKENS_PER_FILE_OVERHEAD,
)
from srcframe.functions.lines import line_count
from srcframe.functions.python_code import python_metrics
from srcframe.functions.tokens import joined_token_count, token_count
from srcframe.operators import filters
from srcframe.operators.pymetrics import python_only, total_complexity
from srcframe.operators.membership import likely
from srcframe.operators.pieces import one_each
from srcframe.session import broadcast_if_small, compute_once, fits_broadcast, materialize

COMPLEXITY_WEIGHT = 10
FUNCTION_WEIGHT = 5
# Parts a group of equal costs is first split into, so no task ranks all of them.
COST_SALTS = 64
# Rounds of the choice that run as one job.
ROUNDS = 4


def pack_inputs(
    files: DataFrame,
    max_kb: int | None = PACK_MAX_FILE_KB,
    exclude_suffixes: tuple[str, ...] = (),
    outputs: DataFrame | None = None,
    marker: str = GENERATED_MARKER,
) -> DataFrame:
    """Texts that may be packed. Suffix and size are tested before the text is read.

    ``max_kb`` None sets no upper limit.
    """
    kept = filters.drop_binary_suffixes(filters.drop_symlinks(files), exclude_suffixes)
    kept = filters.keep_size_band(kept, max_kb)
    if outputs is not None:
        kept = filters.drop_paths(kept, outputs)
    return filters.keep_plain_texts(kept, "start", marker)


def _value(lines: Column, complexity: Column, functions: Column) -> Column:
    return (
        lines
        + F.coalesce(complexity, F.lit(0)) * COMPLEXITY_WEIGHT
        + F.coalesce(functions, F.lit(0)) * FUNCTION_WEIGHT
    ).cast("bigint")


def pack_candidates(
    inputs: DataFrame,
    budget: int = PACK_TOKEN_BUDGET,
    method="pieces",
    metrics: DataFrame | None = None,
) -> DataFrame:
    """(repo, path, walk_key, cost, value, density), without the texts.

    Python metrics are computed in the same pass over the text. Pass stored
    ``metrics`` (repo, path, total_complexity, function_count) to join them instead.
    """
    text = F.col("content")
    fits = (F.col("cost") > 0) & (F.col("cost") + TOKENS_PER_FILE_OVERHEAD <= budget)
    # Only Python texts go on from here, and only to the worker that measures them.
    sized = compute_once(
        inputs, cost=token_count(text, method), lines=line_count(text),
        _python=python_only(text, F.col("suffix")),
    ).where(fits).select("repo", "path", "walk_key", "cost", "lines", "_python")
    if metrics is None:
        parsed = sized.withColumn("_parsed", python_metrics("_python"))
        functions = F.col("_parsed.functions")
        count = F.when(functions.isNotNull(), F.size(functions))
        value = _value(F.col("lines"), total_complexity(functions), count)
    else:
        known = metrics.select("repo", "path", "total_complexity", "function_count")
        parsed = sized.drop("_python").join(known, ["repo", "path"], "left")
        value = _value(F.col("lines"), F.col("total_complexity"), F.col("function_count"))
    return compute_once(parsed, value=value).where(F.col("value") > 0).select(
        "repo", "path", "walk_key", "cost", "value",
        (F.col("value") / F.col("cost")).alias("density"),
    )


def _competitive(fitting: DataFrame, budget: int) -> DataFrame:
    """Candidates that the greedy pass could still take, whatever else it takes.

    Let w = cost + overhead. The budget left only shrinks, so

    * of the files with one w, a prefix in density order is taken, and never more than
      budget // w of them. This bounds each (repository, w) group by the budget.
    * among files with 2^k <= w < 2^(k+1), at most n = budget // 2^k are taken. If one
      of the first n is passed over, less than 2^(k+1) is left, and then one more file
      of this class at most can follow. Past the first n, a file that is no smaller
      than an earlier one past n is thus never taken.

    What remains depends on the budget and not on the size of the repository.
    """
    weight = F.col("cost") + TOKENS_PER_FILE_OVERHEAD
    order = [F.desc("density"), F.asc("walk_key")]
    ranked = fitting.withColumn("_w", weight).withColumn(
        "_salt", F.pmod(F.xxhash64("path"), F.lit(COST_SALTS))
    )
    for group in (["repo", "_w", "_salt"], ["repo", "_w"]):
        ranked = ranked.withColumn(
            "_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        ).where(F.col("_n") <= F.floor(F.lit(budget) / F.col("_w")))
    in_class = Window.partitionBy("repo", "_class").orderBy(*order)
    before = in_class.rowsBetween(Window.unboundedPreceding, -1)
    sized = ranked.withColumn("_class", F.length(F.bin("_w"))).withColumn(
        "_n", F.row_number().over(in_class)
    )
    first = F.col("_n") <= F.floor(F.lit(budget) / F.pow(F.lit(2), F.col("_class") - 1))
    smallest = F.min(F.when(~first, F.col("_w"))).over(before)
    return (
        sized.withColumn("_smallest", smallest)
        .where(first | F.col("_smallest").isNull() | (F.col("_w") < F.col("_smallest")))
        .drop("_w", "_salt", "_n", "_class", "_smallest")
    )


def select_under_budget(candidates: DataFrame, budget: int = PACK_TOKEN_BUDGET) -> DataFrame:
    """Greedy choice by density: take what still fits, pass over what does not.

    Returns (repo, path, cost, density, pick_order). Exact: the candidates are first
    cut to those the greedy pass could take, whose number is bounded by the budget. These
    are taken in rounds of running sums, as rows; no state grows in a row. Texts are not part
    of the plan.
    """
    weight = F.col("cost") + TOKENS_PER_FILE_OVERHEAD
    fitting = candidates.where((F.col("cost") > 0) & (weight <= budget)).select(
        "repo", "path", "walk_key", "cost", "density"
    )
    order = [F.desc("density"), F.asc("walk_key")]
    rows = _competitive(fitting, budget).select(
        "repo", "path", "walk_key", "cost", "density", weight.alias("_w"), F.lit(budget).cast("bigint").alias("_left"),
        F.lit(True).alias("_open"), F.lit(False).alias("_taken"),
        F.row_number().over(Window.partitionBy("repo").orderBy(*order)).alias("_at"))
    while True:
        for _ in range(ROUNDS):
            rows = _round(rows)
        rows = materialize(rows.where(F.col("_open") | F.col("_taken")))
        if rows.where("_open").isEmpty():
            break
    place = F.row_number().over(Window.partitionBy("repo").orderBy("_at"))
    return rows.where("_taken").select("repo", "path", "cost", "density", place.cast("bigint").alias("pick_order"))


def _round(rows: DataFrame) -> DataFrame:
    """Take the longest beginning of what is open that fits, and close what cannot fit any more.

    The first file that does not fit is passed over, as the budget left only shrinks; so is
    every later one above what is left then. Each round takes a file at least. All rounds
    have one partitioning and one order, so Spark shuffles and sorts once.
    """
    so_far = Window.partitionBy("repo").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("repo")
    summed = rows.withColumn("_sum", F.sum(F.when(F.col("_open"), F.col("_w")).otherwise(0)).over(so_far))
    passed = summed.withColumn("_stop", F.min(F.when(F.col("_open") & (F.col("_sum") > F.col("_left")), F.col("_at"))).over(whole))
    now = F.col("_open") & (F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")))
    taken = passed.withColumn("_now", now)
    used = F.coalesce(F.sum(F.when(F.col("_now"), F.col("_w"))).over(whole), F.lit(0))
    left = taken.withColumn("_left", F.col("_left") - used)
    return left.select(
        "repo", "path", "walk_key", "cost", "density", "_w", "_left",
        (F.col("_open") & ~F.col("_now") & (F.col("_at") > F.col("_stop")) & (F.col("_w") <= F.col("_left"))).alias("_open"),
        (F.col("_taken") | F.col("_now")).alias("_taken"), "_at")


def selected_texts(selected: DataFrame, files: DataFrame) -> DataFrame:
    """Join the texts of the chosen files, and of no others.

    Where the list is too long for a broadcast, a bitset of its keys is tested in the scan
    first, so only the texts of candidates (the chosen, and few that pass by chance) are shuffled.
    """
    chosen = materialize(selected.select("repo", "path", "pick_order"))
    texts = files.select("repo", "path", "content")
    if fits_broadcast(chosen):
        return texts.join(F.broadcast(chosen), ["repo", "path"])
    return likely(texts, chosen, ["repo", "path"]).join(chosen, ["repo", "path"])


def pack_blocks(texts: DataFrame) -> DataFrame:
    """(repo, path, pick_order, block): the written form per file; line breaks join blocks."""
    block = F.concat(
        F.lit(f"{PACK_RULE}\nFILE: "), "path", F.lit(f"\n{PACK_RULE}\n"), "content", F.lit("\n")
    )
    return texts.select("repo", "path", "pick_order", block.alias("block"))


def format_pack(
    texts: DataFrame, fmt: str = "raw", now: Column | None = None, marker: str = GENERATED_MARKER
) -> DataFrame:
    """(repo, key, text): the document of each repository as ordered pieces, one row for each file.

    Pieces are joined by line breaks, in the order of their keys; so no row or task holds a
    whole document. ``raw`` has the marker and a block for each file, ``json`` is one object.
    """
    place = F.concat(F.lit("1"), F.lpad(F.col("pick_order").cast("string"), 12, "0"))
    repos = texts.select("repo", "pick_order").where("pick_order = 1")
    if fmt.lower() == "raw":
        files = pack_blocks(texts).select("repo", place.alias("key"), F.col("block").alias("text"))
        return files.unionByName(one_each(repos, "0", F.lit(f"{marker}\n")))
    if fmt.lower() == "json":
        stamp = F.date_format(F.current_timestamp() if now is None else now, TIMESTAMP_FORMAT)
        comma = F.when(F.col("pick_order") > 1, ",").otherwise("")
        files = texts.select(
            "repo", place.alias("key"), F.concat(comma, F.to_json(F.struct("path", "content"))).alias("text"))
        head = F.concat(F.lit('{"pack_date":"'), stamp, F.lit('","files":['))
        return files.unionByName(one_each(repos, "0", head)).unionByName(one_each(repos, "2", F.lit("]}")))
    raise ValueError(f"unknown format: {fmt}")


def document_digests(texts: DataFrame, marker: str = GENERATED_MARKER) -> DataFrame:
    """(repo, digest, chars): MD5 and length of each repository's whole raw document.

    A digest runs over the bytes in their order, so the blocks of a repository are sorted and
    stream through one task; neither a row nor the task's memory holds a document.
    """
    def run(batches):
        import hashlib

        import pyarrow as pa

        def ended():
            return pa.RecordBatch.from_arrays(
                [pa.array([repo], pa.string()), pa.array([digest.hexdigest()], pa.string()), pa.array([chars], pa.int64())],
                names=["repo", "digest", "chars"])

        repo = digest = chars = None
        for batch in batches:
            for name, block in zip(batch.column("repo"), batch.column("block")):
                name, text = name.as_py(), block.as_py()
                if digest is None or name != repo:
                    if digest is not None:
                        yield ended()
                    repo, digest, chars = name, hashlib.md5(f"{marker}\n".encode()), len(marker) + 1
                digest.update(b"\n")
                digest.update(text.encode("utf-8", "surrogatepass"))
                chars += 1 + len(text)
        if digest is not None:
            yield ended()

    ordered = pack_blocks(texts).repartition("repo").sortWithinPartitions("repo", "pick_order")
    return ordered.select("repo", "block").mapInArrow(run, "repo string, digest string, chars bigint")


def pack_stats(
    texts: DataFrame, method="pieces", marker: str = GENERATED_MARKER, repos: DataFrame | None = None
) -> DataFrame:
    """(repo, files_selected, final_token_count) of the raw documents.

    Blocks are counted where they are, so no document is built. ``repos`` adds those that
    have no file to choose, or none that fits the budget, with zeros.
    """
    counted = pack_blocks(texts).groupBy("repo").agg(
        F.count("*").alias("files_selected"),
        joined_token_count(F.col("block"), method, marker, 1).alias("final_token_count"),
    )
    return counted if repos is None else repos.select("repo").distinct().join(counted, "repo", "left").na.fill(0)

"""The four jobs, composed from the operators. Each starts from one ``files`` table."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.constants import PACK_MAX_FILE_KB, PACK_TOKEN_BUDGET
from srcframe.functions import paths
from srcframe.operators import (
    deps, distill as distilling, facts, filters, findings, ignore, keyfiles, options, pack as packing, pymetrics,
    report, secrets as secret_rules, stats, tree,
)
from srcframe.session import materialize
from srcframe.sources.tables import files_from_table
from srcframe.streaming import incremental


def visible_files(
    files: DataFrame,
    include_hidden: bool = False,
    exclude_dirs: Sequence[str] = (),
    exclude_patterns: Sequence[str] = (),
    own_options: DataFrame | None = None,
) -> DataFrame:
    """The files a walk would list. ``own_options`` are exclusions by repository
    (repo, exclude_dirs, exclude_patterns)."""
    kept = filters.exclude_dirs(filters.drop_default_dirs(filters.drop_symlinks(files)), exclude_dirs)
    if not include_hidden:
        kept = filters.drop_hidden(kept)
    kept = filters.exclude_patterns(kept, exclude_patterns)
    # Rules sit in hidden files, so they are read from the unfiltered table.
    kept = ignore.apply_gitignore(kept, ignore.ignore_rules(files))
    return kept if own_options is None else options.apply_exclusions(kept, own_options)


# Stands for an empty directory where paths of files are filtered.
_PROBE = "\u0001"


def scan(
    files: DataFrame,
    include_hidden: bool = False,
    exclude_dirs: Sequence[str] = (),
    exclude_patterns: Sequence[str] = (),
    max_files: int | None = None,
    custom_rules: dict | None = None,
    empty_dirs: DataFrame | None = None,
    now: Column | None = None,
    own_options: DataFrame | None = None,
    store: str | None = None,
    run: int = 0,
) -> report.Sections:
    """The report of every repository of ``files``, also of those where nothing is visible.

    Texts are read once; stored facts of each file feed all sections. ``own_options`` are
    exclusions by repository (repo, exclude_dirs, exclude_patterns). ``max_files`` makes the
    job fail on a larger repository; without it there is no limit. With ``store``, a folder, the
    facts of texts that an earlier run analysed are read from there, and those of others are
    added as run number ``run``; without it every text is analysed.
    """
    began = time.perf_counter()
    everything = files
    if empty_dirs is not None:
        everything = files.unionByName(files_from_table(
            empty_dirs.select("repo", F.concat("path", F.lit(f"/{_PROBE}")).alias("path"), F.lit("").alias("content"))))
    kept = visible_files(everything, include_hidden, exclude_dirs, exclude_patterns, own_options)
    seen = kept.where(F.col("name") != _PROBE)
    dirs = None
    if empty_dirs is not None:
        dirs = kept.where(F.col("name") == _PROBE).select("repo", paths.parent_dir(F.col("path")).alias("path"))
    if max_files is not None:
        seen = filters.guard_max_files(seen, max_files)
    sized = ignore.with_lfs(seen, ignore.lfs_patterns(files))
    if store is None:
        per_file = materialize(facts.file_facts(sized))
    else:
        held = incremental.update_store(sized, store, run, facts.text_facts)
        per_file = materialize(facts.placed_facts(sized, held.dropDuplicates(incremental.KEY)))
    repos = materialize(everything.select("repo").distinct())
    return report_of(
        per_file, deps.dependency_lists(files), custom_rules, now, dirs, repos, time.perf_counter() - began)


def report_of(
    per_file: DataFrame, dependency_lists: DataFrame, custom_rules: dict | None = None, now: Column | None = None,
    dirs: DataFrame | None = None, repos: DataFrame | None = None, seconds: float = 0.0,
) -> report.Sections:
    """The report from stored file facts; no text is read again."""
    known = per_file.where(F.col("language").isNotNull())
    parsed = per_file.where(F.col("parsed").isNotNull())
    records = report.assemble_report(
        totals=stats.repo_totals(per_file, known),
        primary=stats.primary_language(known),
        languages=stats.language_lines(known),
        complexity=pymetrics.repo_complexity(pymetrics.file_metrics(parsed)),
        markers=stats.marker_totals(per_file),
        top_functions=pymetrics.top_complex_functions(pymetrics.function_metrics(parsed)),
        largest=keyfiles.largest_files(per_file, 10),
        dependency_map=deps.dependency_map(dependency_lists),
        repos=repos,
        duration_seconds=round(seconds, 2),
        now=now,
    )
    return report.Sections(
        records, tree.nest_tree(per_file, dirs, repos), keyfiles.important_files(per_file, custom_rules),
        secret_rules.listed_secrets(per_file))


class Packed(NamedTuple):
    selected: DataFrame
    texts: DataFrame


def pack(
    files: DataFrame,
    budget: int = PACK_TOKEN_BUDGET,
    max_kb: int | None = PACK_MAX_FILE_KB,
    exclude_suffixes: tuple[str, ...] = (),
    method="pieces",
    outputs: DataFrame | None = None,
    **visible,
) -> Packed:
    """The choice under the budget, and the chosen texts.

    ``visible`` are options of :func:`visible_files`. It is an error if no file of any
    repository can be packed.
    """
    inputs = packing.pack_inputs(visible_files(files, **visible), max_kb, exclude_suffixes, outputs)
    candidates = packing.pack_candidates(inputs, budget, method)
    selected = materialize(packing.select_under_budget(candidates, budget))
    if selected.isEmpty():
        raise ValueError("no file can be packed: all are empty, too large, binary or above the budget")
    return Packed(selected, packing.selected_texts(selected, inputs))


class Distilled(NamedTuple):
    texts: DataFrame
    ranges: DataFrame
    keys: DataFrame  # (repo, walk_key) of all files that were to be shortened; no text is read for it


def distill(
    files: DataFrame, level: int = 2, anchors: bool = True, outputs: DataFrame | None = None, **visible
) -> Distilled:
    """The shortened texts, and where each stands in the written result.

    ``visible`` are options of :func:`visible_files`.
    """
    seen = visible_files(files, **visible)
    texts = distilling.distilled(distilling.distill_inputs(seen, outputs), level, anchors)
    keys = filters.keep_source_suffixes(filters.drop_symlinks(seen)).select("repo", "walk_key")
    return Distilled(texts, distilling.line_ranges(texts), keys)


class Audited(NamedTuple):
    findings: DataFrame
    summary: DataFrame


def audit(files: DataFrame, dependency_scans: DataFrame, code_scans: DataFrame) -> Audited:
    """All findings and their counts; secrets are sought in hidden files too."""
    found = findings.threat_assessment(
        findings.parse_dependency_scan(dependency_scans),
        findings.parse_code_scan(code_scans),
        secret_rules.find_secrets(visible_files(files, include_hidden=True)),
    )
    repos = files.select("repo").union(dependency_scans.select("repo")).union(code_scans.select("repo"))
    return Audited(found, findings.finding_summary(found, repos))

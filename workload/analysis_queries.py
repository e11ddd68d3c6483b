"""Sums, rankings, selections, documents and reports."""

from pyspark.sql import functions as F

from srcframe.operators import (
    deps, distill, facts, findings, keyfiles, ordering, pack, pymetrics, report, secrets, stats, tree,
)
from srcframe.plans import jobs
from srcframe.session import materialize
from srcframe.sources.sinks import distill_map
from srcframe.sources.tables import files_from_table
from srcframe.streaming import incremental
from workload.bindings import (
    CODE_REPO, DEP_REPO, FILES, MODULES, PACKAGE_JSON, PYPROJECT, REQUIREMENTS, sql_files,
)
from workload.corpus_queries import PACKAGE_ROWS, PYPROJECT_ROWS, REQUIREMENT_ROWS, SECRETS
from workload.fragments import (
    DISTILLABLE, GENERATED_MARKER, IMPORTANT, MARKS, MODULE_FACTS, NOT_SOURCE, PACKABLE, STATS,
    distill as sql_distill, greedy, sql_lines, tokens,
)
from workload.registry import query

BUDGET = 8000


# --- sums -------------------------------------------------------------------------------

LANGUAGE_LINES = FILES + ", " + STATS + " select repo, language, cast(sum(code) as bigint) as code from stats group by all"


@query("language_lines", LANGUAGE_LINES)
def language_lines(c):
    return stats.language_lines(stats.file_stats(c.files))


@query("repo_totals", FILES + ", " + STATS + """
  select f.repo, f.total_files, cast(coalesce(s.loc, 0) as bigint) as total_lines_of_code
  from (select repo, count(*) as total_files from files group by repo) f
  left join (select repo, sum(code) as loc from stats group by repo) s on s.repo = f.repo""")
def _(c):
    return stats.repo_totals(c.files, stats.file_stats(c.files))


PRIMARY = """primary_languages as (
  select repo, language as primary_language from (
    select repo, language, row_number() over (partition by repo order by sum(code) desc, min(walk_key)) as n
    from stats group by repo, language) where n = 1)"""


@query("primary_language", FILES + ", " + STATS + ", " + PRIMARY + " select * from primary_languages")
def _(c):
    return stats.primary_language(stats.file_stats(c.files))


@query("repo_complexity", "with " + MODULE_FACTS + """
  select repo, cast(sum(function_count) as bigint) as total_functions_found,
    round(sum(total_complexity) / cast(sum(function_count) as double), 2) as average_cyclomatic_complexity
  from metrics group by repo""")
def _(c):
    return pymetrics.repo_complexity(pymetrics.file_metrics(pymetrics.parsed_files(c.modules)))


@query("marker_totals", FILES + ", " + MARKS + """
  select repo, cast(sum(todo_count) as bigint) as todo_count, cast(sum(fixme_count) as bigint) as fixme_count
  from marks group by repo""")
def _(c):
    return stats.marker_totals(stats.marker_counts(c.files))


DIR_SIZES = """dir_sizes as (
  select repo, array_to_string(dirs[:i], '/') as dir, cast(sum(size_bytes) as bigint) as size_bytes
  from (select repo, dirs, size_bytes, unnest(range(1, len(dirs) + 1)) as i from files) group by all)"""


@query("directory_sizes", FILES + ", " + DIR_SIZES + " select * from dir_sizes")
def _(c):
    return tree.directory_sizes(c.files)


@query("dependency_lists", f"""with rows as (({REQUIREMENT_ROWS}) union all ({PACKAGE_ROWS}) union all ({PYPROJECT_ROWS}))
  select repo, manifest, md5(string_agg(dep, '|' order by pos)) as names, count(*) as n from rows group by repo, manifest""")
def _(c):
    files = (
        c.manifests("requirements.txt", REQUIREMENTS)
        .unionByName(c.manifests("package.json", PACKAGE_JSON))
        .unionByName(c.manifests("pyproject.toml", PYPROJECT))
    )
    listed = deps.dependency_lists(files)
    return listed.select(
        "repo", "manifest", F.md5(F.encode(F.array_join("deps", "|"), "UTF-8")).alias("names"),
        F.size("deps").cast("bigint").alias("n"),
    )


# --- findings ---------------------------------------------------------------------------

DEP_FINDINGS = f"""dep_findings as (
  select {DEP_REPO} as repo, case when n = 1 then 'V-' || l_suppkey else '' end as id, 'part' || l_partkey as package_name,
    case when l_linenumber % 3 = 0 then 'unknown' else '1.' || l_linenumber end as vulnerable_version,
    case when n = 1 then l_returnflag || ' risk' else 'second' end as summary,
    case when n = 1 and l_linenumber % 2 <> 0 then l_linestatus end as severity
  from lineitem cross join (values (1), (2)) t(n) where l_orderkey % 11 <> 0 and l_orderkey % 17 <> 0)"""
CODE_FINDINGS = f"""code_findings as (
  select {CODE_REPO} as repo, 'rule.' || event_type as check_id, 'src/' || user_id || '.py' as path,
    case when event_id % 3 = 0 then 0 else event_id % 500 + 1 end as line,
    case when event_id % 4 = 0 then '' else 'found ' || event_type end as message,
    case when event_id % 4 = 0 or event_id % 5 = 0 then 'INFO' else 'ERROR' end as severity
  from events where event_id % 13 <> 0 and event_id % 19 <> 0)"""


@query("dependency_findings", f"with {DEP_FINDINGS} select * from dep_findings")
def _(c):
    return findings.parse_dependency_scan(c.dep_scans)


@query("code_findings", f"with {CODE_FINDINGS} select * from code_findings")
def _(c):
    return findings.parse_code_scan(c.code_scans)


def _threats(c):
    files = files_from_table(c.table("documents").selectExpr(
        "'order' || (doc_id % 100) as repo", "doc_id || '.txt' as path", "text as content"
    ))
    return findings.threat_assessment(
        findings.parse_dependency_scan(c.dep_scans), findings.parse_code_scan(c.code_scans),
        secrets.find_secrets(files),
    )


THREATS = f"""with secret_files as (
    select 'order' || (doc_id % 100) as repo, doc_id || '.txt' as path, text as content from documents),
  {SECRETS}, {DEP_FINDINGS}, {CODE_FINDINGS},
  threats as (
    select *, 'dependency' as kind from dep_findings
    union all by name select *, 'code' as kind from code_findings
    union all by name select *, 'secret' as kind from found)"""


@query("threat_assessment", f"""{THREATS}
  select kind, repo, id, package_name, vulnerable_version, summary, severity, check_id, path, line, message,
    file_path, secret_type, line_number, line_content from threats""")
def _(c):
    return _threats(c).withColumn("line_number", F.col("line_number").cast("bigint"))


_AUDITED = "select distinct 'order' || (o_orderkey % 120) as repo from orders"


@query("finding_summary", f"""{THREATS}, audited as ({_AUDITED})
  select repo, count(*) filter (kind = 'dependency') as dependency_count, count(*) filter (kind = 'code') as code_count,
    count(*) filter (kind = 'secret') as secret_count, count(kind) > 0 as has_findings
  from audited left join threats using (repo) group by repo""")
def _(c):
    audited = c.table("orders").selectExpr("'order' || (o_orderkey % 120) as repo").distinct()
    return findings.finding_summary(_threats(c), audited)


# --- rankings ---------------------------------------------------------------------------

@query("walk_order", FILES + " select repo, path, row_number() over (partition by repo order by walk_key) as ordinal from files")
def _(c):
    return ordering.walk_order(c.files)


@query("top_complex_functions", "with " + MODULE_FACTS + """
  select repo, rank, path as file_path, function_name, line_number, complexity_score from (
    select *, row_number() over (partition by repo order by complexity_score desc, walk_key, ord) as rank from functions)
  where rank <= 5""")
def _(c):
    top = pymetrics.top_complex_functions(pymetrics.function_metrics(pymetrics.parsed_files(c.modules)))
    return top.withColumns({n: F.col(n).cast("bigint") for n in ("rank", "line_number", "complexity_score")})


LARGEST = f"""largest as (
  select repo, rank, path, size_bytes from (
    select *, row_number() over (partition by repo order by size_bytes desc, walk_key) as rank
    from files where suffix not in {NOT_SOURCE}) where rank <= 10)"""


@query("largest_files", FILES + ", " + LARGEST + " select * from largest")
def _(c):
    return keyfiles.largest_files(c.files, 10).drop("is_lfs").withColumn("rank", F.col("rank").cast("bigint"))


@query("important_files", FILES + f" select repo, path from files where {IMPORTANT}")
def _(c):
    return keyfiles.important_files(c.files)


_OWN_RULES = """select source as repo, 'name' as kind, 'DOCKERFILE' as value from documents where doc_id % 2 = 0
  union select source, 'suffix', case when lang = 'en' then '.Md' else '.sh' end from documents
  union select source, 'substring', 'Mod' || (doc_id % 10) from documents where doc_id % 3 = 0"""


@query("important_files_by_repo", FILES + f""", own as ({_OWN_RULES})
  select distinct f.repo, f.path from files f join own r on r.repo = f.repo and (
    (kind = 'name' and lower(value) = lower(name)) or (kind = 'suffix' and lower(value) = suffix)
    or (kind = 'substring' and contains(lower(name), lower(value))))""")
def _(c):
    docs = c.table("documents")
    rules = (
        docs.where("doc_id % 2 = 0").selectExpr("source as repo", "'name' as kind", "'DOCKERFILE' as value")
        .union(docs.selectExpr("source", "'suffix'", "case when lang = 'en' then '.Md' else '.sh' end"))
        .union(docs.where("doc_id % 3 = 0").selectExpr("source", "'substring'", "'Mod' || (doc_id % 10)"))
    )
    return keyfiles.important_files_by_repo(c.files, rules.distinct())


@query("important_lists", FILES + f"""
  select repo, path, row_number() over (partition by repo order by path) as ordinal from files where {IMPORTANT}""")
def _(c):
    return keyfiles.important_lists(keyfiles.important_files(c.files))


# --- pack -------------------------------------------------------------------------------

CANDIDATES = PACKABLE + f""", candidates as (
  select *, value / cast(cost as double) as density from (
    select repo, path, walk_key, {tokens('content')} as cost, len({sql_lines('content')}) as value from packable)
  where cost > 0 and cost + 50 <= {BUDGET} and value > 0)"""


def _candidates(c):
    return pack.pack_candidates(pack.pack_inputs(c.files, max_kb=None), BUDGET)


@query("pack_candidates", FILES + ", " + CANDIDATES + " select repo, path, cost, value, density from candidates")
def _(c):
    return _candidates(c).drop("walk_key")


MODULE_CANDIDATES = MODULES + f""", {MODULE_FACTS},
  candidates as (
    select *, value / cast(cost as double) as density from (
      select m.repo, m.path, m.walk_key, {tokens('content')} as cost,
        len({sql_lines('content')}) + 10 * coalesce(total_complexity, 0) + 5 * coalesce(function_count, 0) as value
      from modules m left join metrics f on f.repo = m.repo and f.path = m.path where m.disk_size > 0)
    where cost + 50 <= {BUDGET})"""


@query("module_candidates", MODULE_CANDIDATES + " select repo, path, cost, value, density from candidates")
def _(c):
    return pack.pack_candidates(pack.pack_inputs(c.modules, max_kb=None), BUDGET).drop("walk_key")


@query("module_candidates_from_stored_metrics", MODULE_CANDIDATES + " select repo, path, cost, value, density from candidates")
def _(c):
    stored = pymetrics.file_metrics(pymetrics.parsed_files(c.modules))
    return pack.pack_candidates(pack.pack_inputs(c.modules, max_kb=None), BUDGET, metrics=stored).drop("walk_key")


SELECTED = FILES.replace("with ", "with recursive ", 1) + ", " + CANDIDATES + ", " + greedy(BUDGET)


@query("budget_selection", SELECTED + " select repo, path, cost, density, pick_order from picked")
def _(c):
    return pack.select_under_budget(_candidates(c), BUDGET)


def _selected(c):
    return pack.selected_texts(pack.select_under_budget(_candidates(c), BUDGET), c.files)


@query("selected_texts", SELECTED + """
  select p.repo, p.path, p.pick_order, sha256(f.content) as content_hash
  from picked p join files f on f.repo = p.repo and f.path = p.path""")
def _(c):
    return _selected(c).select(
        "repo", "path", "pick_order", F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash")
    )


_RULE = "=" * 42
PACKED = SELECTED + f""", documents_raw as (
  select p.repo, '{GENERATED_MARKER}' || chr(10) || chr(10) || string_agg(
    '{_RULE}' || chr(10) || 'FILE: ' || p.path || chr(10) || '{_RULE}' || chr(10) || f.content || chr(10), chr(10) order by pick_order) as document
  from picked p join files f on f.repo = p.repo and f.path = p.path group by p.repo)"""


_PIECES = """select repo, key, md5(text) as digest, length(text) as chars from ({pieces})"""


def _digested(pieces):
    return pieces.select(
        "repo", "key", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query("pack_documents", PACKED + " " + _PIECES.format(pieces=f"""
  select p.repo, '1' || lpad(cast(pick_order as varchar), 12, '0') as key,
    '{_RULE}' || chr(10) || 'FILE: ' || p.path || chr(10) || '{_RULE}' || chr(10) || f.content || chr(10) as text
  from picked p join files f on f.repo = p.repo and f.path = p.path
  union all select distinct repo, '0', '{GENERATED_MARKER}' || chr(10) from picked
  union all select repo, 'whole', document from documents_raw"""))
def _(c):
    texts = _selected(c)
    whole = pack.document_digests(texts).select("repo", F.lit("whole").alias("key"), "digest", "chars")
    return _digested(pack.format_pack(texts, "raw")).unionByName(whole)


@query("pack_json", SELECTED + """ select repo, key, path, md5(content) as digest, length(content) as chars from (
  select p.repo, '1' || lpad(cast(pick_order as varchar), 12, '0') as key, p.path, f.content
  from picked p join files f on f.repo = p.repo and f.path = p.path
  union all select distinct repo, '0', '', '{"pack_date":"2024-01-01T00:00:00Z","files":[' from picked
  union all select distinct repo, '2', '', ']}' from picked)""")
def _(c):
    pieces = pack.format_pack(_selected(c), "json", now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    # Files are read back, so that the check is on what a reader of the document gets.
    is_file = F.substring("key", 1, 1) == "1"
    read = F.from_json(F.regexp_replace("text", "^,", ""), "path string, content string")
    both = pieces.withColumn("f", F.when(is_file, read)).select(
        "repo", "key", F.coalesce("f.path", F.lit("")).alias("path"), F.when(is_file, F.col("f.content")).otherwise(F.col("text")).alias("text"))
    return both.select(
        "repo", "key", "path", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query("pack_stats", PACKED + f"""
  select d.repo, n as files_selected, {tokens('document')} as final_token_count
  from documents_raw d join (select repo, count(*) as n from picked group by repo) p on p.repo = d.repo""")
def _(c):
    return pack.pack_stats(_selected(c))


@query("pack_stats_chars", PACKED + f"""
  select r.repo, coalesce(n, 0) as files_selected, coalesce((length(document) + 3) // 4, 0) as final_token_count
  from (select distinct source as repo from documents union all select 'none-' || lang from documents group by lang
        union all values ('web'), ('conv')) r
  left join documents_raw d on d.repo = r.repo left join (select repo, count(*) as n from picked group by repo) p on p.repo = r.repo""")
def _(c):
    # Repositories without any file are among those that were to be packed.
    wanted = c.files.select("repo").union(c.table("documents").selectExpr("'none-' || lang"))
    return pack.pack_stats(_selected(c), "chars4", repos=wanted)


# --- distill ----------------------------------------------------------------------------

DISTILLED = FILES + ", " + DISTILLABLE + f""", distilled as (
  select repo, path, walk_key, d, len({sql_lines('d')}) as n
  from (select *, {sql_distill('content')} as d from distillable) where d <> ''),
ranges as (
  select repo, path, n, walk_key, 4 + coalesce(sum(n + 5) over (
    partition by repo order by walk_key rows between unbounded preceding and 1 preceding), 0) as start
  from distilled)"""


def _distilled(c):
    return distill.distilled(distill.distill_inputs(c.files), level=1)


@query("line_ranges", DISTILLED + """
  select repo, path, cast(start as bigint) as first_line, cast(start + n - 1 as bigint) as last_line,
    cast(start + 2 as bigint) as output_first_line, cast(start + n + 1 as bigint) as output_last_line from ranges""")
def _(c):
    return distill.line_ranges(_distilled(c)).drop("walk_key")


@query("distill_blocks", DISTILLED + f"""
  select repo, path, md5('{"=" * 50}' || chr(10) || '--- FILE: ' || path || ' ---' || chr(10) || '{"=" * 50}' || chr(10) || d || chr(10) || chr(10)) as digest
  from distilled""")
def _(c):
    blocks = distill.distilled_blocks(_distilled(c))
    return blocks.select("repo", "path", F.md5(F.encode("block", "UTF-8")).alias("digest"))


@query("distill_map", DISTILLED + """
  select repo, path as source_file, '0.1.0' as version, cast(1 as bigint) as level, cast(start as bigint) as first_line,
    cast(start + n - 1 as bigint) as last_line from ranges""")
def _(c):
    mapped = distill_map(distill.line_ranges(_distilled(c)), 1)
    read = F.from_json("value", "version string, distillation_level bigint, distilled_range array<bigint>, source_file string")
    return mapped.select("repo", read.alias("m")).select(
        "repo", "m.source_file", "m.version", F.col("m.distillation_level").alias("level"),
        F.col("m.distilled_range")[0].alias("first_line"), F.col("m.distilled_range")[1].alias("last_line"),
    )


@query("distill_stats", DISTILLED + f""", texts as (
    select repo, count(*) as n, '{GENERATED_MARKER}' || chr(10) || chr(10) || string_agg(
      '{"=" * 50}' || chr(10) || '--- FILE: ' || path || ' ---' || chr(10) || '{"=" * 50}' || chr(10) || d || chr(10) || chr(10), chr(10) order by walk_key) as t
    from distilled group by repo)
  select repo, n as files_processed, {tokens('t')} as total_tokens from texts""")
def _(c):
    return distill.distill_stats(distill.distilled_blocks(_distilled(c)))


@query("distill_stats_chars", DISTILLED + f""", texts as (
    select repo, count(*) as n, '{GENERATED_MARKER}' || chr(10) || chr(10) || string_agg(
      '{"=" * 50}' || chr(10) || '--- FILE: ' || path || ' ---' || chr(10) || '{"=" * 50}' || chr(10) || d || chr(10) || chr(10), chr(10) order by walk_key) as t
    from distilled group by repo)
  select repo, n as files_processed, (length(t) + 3) // 4 as total_tokens from texts""")
def _(c):
    return distill.distill_stats(distill.distilled_blocks(_distilled(c)), "chars4")


# --- trees and reports ------------------------------------------------------------------

@query("tree_nodes", FILES + ", " + DIR_SIZES + """
  select repo, path, name, 'file' as type, len(dirs) as depth, size_bytes, walk_key from files
  union all
  select repo, dir, regexp_extract(dir, '[^/]*$'), 'directory', len(string_split(dir, '/')) - 1, size_bytes,
    '0' || replace(dir, '/', chr(0) || '0') || chr(0) from dir_sizes""")
def _(c):
    nodes = tree.tree_nodes(c.files)
    return nodes.select("repo", "path", "name", "type", F.col("depth").cast("bigint").alias("depth"), "size_bytes", "walk_key")


def _json_text(x: str) -> str:
    return f"""'"' || replace(replace({x}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'"""


# The pieces of the documents, written from the definition of the nested form.
TREE = f"""nodes as (
    select repo, walk_key as key, dir as parent, name, 'file' as type, size_bytes from files
    union all
    select repo, '0' || replace(dir, '/', chr(0) || '0') || chr(0), regexp_extract(dir, '^(.*)/[^/]*$', 1),
      regexp_extract(dir, '[^/]*$'), 'directory', size_bytes from dir_sizes),
  tree_pieces as (
    select repo, key, case when row_number() over (partition by repo, parent order by key) = 1 then '' else ',' end
      || '{{"name":' || {_json_text('name')} || ',"type":"' || type || '","size_bytes":' || size_bytes || ',"children":'
      || case when type = 'file' then 'null,"is_lfs_pointer":false,"real_size":null}}' else '[' end as text from nodes
    union all select repo, key || '2', '],"is_lfs_pointer":false,"real_size":null}}' from nodes where type = 'directory'
    union all select distinct repo, '', '[' from files
    union all select distinct repo, '3', ']' from files)"""


@query("nested_tree", FILES + ", " + DIR_SIZES + ", " + TREE + " select * from tree_pieces")
def _(c):
    return tree.nest_tree(c.files)


@query("flattened_tree", FILES + """
  select repo, path, 'file' as type, size_bytes, false as is_lfs_pointer, cast(null as bigint) as real_size from files""")
def _(c):
    return tree.flatten_tree(tree.nest_tree(c.files))


REPORT_SECRETS = SECRETS.replace("secret_files", "files")


def _sections(c):
    per_file = materialize(facts.file_facts(c.files))
    return jobs.report_of(
        per_file, deps.dependency_lists(c.files), now=F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("reports", FILES + ", " + STATS + ", " + MARKS + ", " + PRIMARY + ", " + LARGEST + """
  select f.repo, '2024-01-01T00:00:00Z' as timestamp, count(*) as total_files,
    (select cast(coalesce(sum(code), 0) as bigint) from stats s where s.repo = f.repo) as total_lines_of_code,
    (select primary_language from primary_languages p where p.repo = f.repo) as primary_language,
    (select coalesce(string_agg(language || '=' || n, ',' order by language), '') from (
      select language, cast(sum(code) as bigint) as n from stats s where s.repo = f.repo group by language)) as languages,
    (select cast(sum(todo_count) as bigint) from marks m where m.repo = f.repo) as todo_count,
    (select cast(sum(fixme_count) as bigint) from marks m where m.repo = f.repo) as fixme_count,
    (select coalesce(string_agg(path || '=' || size_bytes, ',' order by rank), '') from largest l where l.repo = f.repo) as largest
  from files f group by f.repo""")
def _(c):
    r = "report."
    pairs = lambda name, a, b: F.array_join(
        F.transform(name, lambda x: F.concat(x[a], F.lit("="), x[b].cast("string"))), ",")
    return _sections(c).records.select(
        "repo", r + "analysis_metadata.timestamp",
        r + "repository_summary.total_files", r + "repository_summary.total_lines_of_code",
        r + "repository_summary.primary_language",
        pairs(F.map_entries(r + "repository_summary.language_stats"), "key", "value").alias("languages"),
        r + "code_insights.todo_count", r + "code_insights.fixme_count",
        pairs(F.col(r + "key_files.largest_files"), "path", "size_bytes").alias("largest"),
    )


@query("report_lists", FILES + ", " + DIR_SIZES + ", " + TREE + ", " + REPORT_SECRETS + f"""
  select repo, 'b' || key as key, text from tree_pieces
  union all
  select repo, 'd' || path, case when row_number() over (partition by repo order by path) = 1 then '' else ',' end || {_json_text('path')}
  from files where {IMPORTANT}
  union all
  select repo, 'f' || file_path || chr(0) || lpad(cast(line_number as varchar), 12, '0') || chr(0) || secret_type,
    case when row_number() over (partition by repo order by file_path, line_number, secret_type) = 1 then '' else ',' end
      || '{{"file_path":' || {_json_text('file_path')} || ',"secret_type":"' || secret_type || '","line_number":' || line_number
      || ',"line_content":' || {_json_text('line_content')} || '}}'
  from found""")
def _(c):
    return report.report_json(_sections(c)).where("substr(key, 1, 1) in ('b', 'd', 'f')")


# --- reuse of stored results ------------------------------------------------------------

# The store knows an earlier state of the documents: some were not there, some differed.
_EARLIER = "case when doc_id % 5 = 0 then text || '!' else text end"
_PLACE = "doc_id || case when doc_id % 7 = 6 then '.txt' when doc_id % 2 = 0 then '.md' else '.sh' end"


def _now_and_before(c):
    docs = c.table("documents")
    now = files_from_table(docs.selectExpr("source as repo", f"{_PLACE} as path", "text as content"))
    before = files_from_table(docs.where("doc_id % 3 <> 0").selectExpr(
        "source as repo", f"{_PLACE} as path", f"{_EARLIER} as content"
    ))
    return now, before


@query("unseen_versions", f"""
  select source as repo, {_PLACE} as path, sha256(text) as content_hash from documents where doc_id % 3 = 0 or doc_id % 5 = 0""")
def _(c):
    now, before = _now_and_before(c)
    return incremental.unseen_versions(now, incremental.file_versions(before))


@query("stored_results", f"""
  select source as repo, {_PLACE} as path, sha256(text) as content_hash,
    case when doc_id % 3 <> 0 and doc_id % 5 <> 0 and doc_id % 7 <> 6 then n end as code
  from (select *, len(list_filter({sql_lines('text')}, lambda l: regexp_matches(l, '[^ \t]') and not (doc_id % 2 = 1 and starts_with(ltrim(l), '#')))) as n from documents)""")
def _(c):
    now, before = _now_and_before(c)
    known = stats.file_stats(before).select("repo", "path", "content_hash", "code")
    return incremental.stored_results(now, known)


_ALL_STATS = "with " + sql_files((("documents", "source", _PLACE, "text"),)) + ", " + STATS + """,
  versions as (select repo, path, sha256(content) as content_hash, cast(regexp_extract(path, '^[0-9]+') as bigint) as doc_id from files)"""


@query("changed_files_analysed", _ALL_STATS + """
  select v.repo, v.path, v.content_hash, language, code, blank, comment, cast(7 as bigint) as version
  from versions v left join stats s on s.repo = v.repo and s.path = v.path where doc_id % 3 = 0 or doc_id % 5 = 0""")
def _(c):
    now, before = _now_and_before(c)
    out = incremental.analyse_changes(now, incremental.file_versions(before), version=7)
    return out.drop("function_count", "total_complexity")


@query("current_results", _ALL_STATS + """
  select v.repo, v.path, v.content_hash, code, cast(case when doc_id % 4 = 0 then 0 else 1 end as bigint) as version
  from versions v left join stats s on s.repo = v.repo and s.path = v.path where doc_id % 10 <> 9""")
def _(c):
    # Run 0 saw a part of the texts, run 1 all, and files with another text; some files have gone since.
    now, before = _now_and_before(c)
    docs = c.table("documents")
    part = files_from_table(docs.where("doc_id % 4 = 0").selectExpr("source as repo", f"{_PLACE} as path", "text as content"))
    runs = [incremental.analyse(part), incremental.analyse_changes(now, incremental.file_versions(part)), incremental.analyse(before)]
    numbered = [r.drop("version").withColumn("version", F.lit(n).cast("bigint")) for r, n in zip(runs, (0, 1, 2))]
    store = numbered[0].unionByName(numbered[1]).unionByName(
        numbered[2].where("cast(regexp_extract(path, '^([0-9]+)', 1) as bigint) % 5 = 0"))
    left = now.where("cast(regexp_extract(path, '^([0-9]+)', 1) as bigint) % 10 <> 9")
    current = incremental.current_results(incremental.file_versions(left), store)
    return current.select("repo", "path", "content_hash", "code", "version")

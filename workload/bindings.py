"""The given tables bound to the inputs of the operators.

Every row of a bound table comes from a row of a given table; paths, rule files,
manifests, code and scanner documents are written from its columns. The expressions
use only what Spark SQL and DuckDB share, so both sides read the same inputs.
"""

from __future__ import annotations

import re
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcframe.constants import GENERATED_MARKER, LFS_SPEC_LINE
from srcframe.session import compute_once
from srcframe.sources.tables import files_from_table

NL = "\n"

_EXT = """case doc_id % 6 when 0 then '.md' when 1 then '.txt' when 2 then '.py'
  when 3 then '.sh' when 4 then '.js' else '.rst' end"""
_TOP = """case doc_id % 13 when 0 then 'node_modules/' when 1 then '.github/'
  when 2 then 'src/__pycache__/' when 3 then 'build/' when 4 then 'data/' else '' end"""
_NAME = f"""case doc_id % 17
  when 0 then '.' || doc_id || {_EXT}
  when 1 then 'main_' || doc_id || {_EXT}
  when 2 then doc_id || '.TAR.GZ'
  when 3 then doc_id || '/Dockerfile'
  when 4 then doc_id || '.png'
  when 5 then doc_id || '.'
  when 6 then 'app-config' || doc_id || '.YML'
  when 7 then 'notes' || doc_id || '.log'
  when 8 then 'mod' || doc_id || '.PY'
  else doc_id || {_EXT} end"""
PATH = f"{_TOP} || lang || '/' || (doc_id % 7) || '/' || {_NAME}"

CONTENT = f"""case
  when doc_id % 8 = 1 then replace(text, '. ', '.{NL}# TODO: ')
  when doc_id % 8 = 2 then replace(text, ', ', ',\r{NL}\t')
  when doc_id % 8 = 3 then '\"\"\"' || text || '\"\"\"{NL}{NL}{NL}{NL}x = "a#b"  # fixme{NL}'
  when doc_id % 8 = 4 then replace(text, '. ', '.  \u000b')
  when doc_id % 8 = 5 then '// ' || replace(text, '. ', '.{NL}   // FIXME todo_x ')
  when doc_id % 8 = 6 and doc_id % 48 = 6 then text || chr(0) || '{NL}'
  when doc_id % 8 = 6 then text || '{NL}{NL}   {NL}'
  when doc_id % 24 = 7 then '{GENERATED_MARKER}{NL}' || text
  when doc_id % 8 = 7 then '   ' || text || '{NL}\u0085'
  else text end"""

_POINTER = f"""'{LFS_SPEC_LINE}' || '{NL}oid sha256:' || doc_id
  || case when doc_id % 4 = 0 then repeat('{NL}x-note some longer line of the pointer', 20) else '' end
  || '{NL}size ' || (n_chars * 1000) || '{NL}'"""

# (table, repo, path, content) of the bound files. All texts are in; pointer and empty
# files are rows of their own.
FILE_PARTS = (
    ("documents", "source", PATH, CONTENT),
    ("(select * from documents where doc_id % 34 = 4)", "source", "lang || '/' || (doc_id % 7) || '/p' || doc_id || '.png'", _POINTER),
    ("(select * from documents where doc_id % 24 = 15)", "source", f"'none/' || doc_id || {_EXT}", "''"),
    ("pages", "'web'", "'site/' || (page_id % 9) || '/' || page_id || '.html'", "html"),
    ("conversations", "'conv'", "'c' || (conv_id % 5) || '/' || conv_id || '/' || turn || '-' || role || '.txt'", "text"),
)

# A module per document: its text as comment lines, then code whose shape depends on doc_id.
_BRANCHES = f"repeat('    if a > 1 and b:{NL}        x = 1{NL}', cast(doc_id % 4 as int))"
_COMMENTS = f"'# ' || replace(replace(replace(text, chr(13), ' '), chr(0), ' '), '{NL}', '{NL}# ') || '{NL}'"
MODULE_PATH = "'lib/' || (doc_id % 3) || '/m' || doc_id || '.py'"
MODULE_BODY = f"'    x = a{NL}' || {_BRANCHES} || '    return x'"
MODULE = f"""{_COMMENTS} || case when doc_id % 10 = 9 then 'def (:{NL}' else
  'def f' || doc_id || '(a, b=1):{NL}' || {MODULE_BODY} || '{NL}{NL}'
  || 'class C' || doc_id || ':{NL}    def m(self):{NL}        return 0{NL}{NL}'
  || 'async def g' || doc_id || '(q):{NL}    for i in q:{NL}        pass{NL}    return [i for i in q if i]{NL}' end"""

# Every document also is a repository of its own with manifests written from its words.
REQUIREMENTS = f"replace(replace(text, ' ', case when doc_id % 2 = 0 then '>=1.0{NL}' else ' # note{NL}  ' end), '. ', '{NL}{NL}# c{NL}')"
_CLEAN = "translate(text, '\"\\\\' || chr(10) || chr(9) || chr(13), '')"
PACKAGE_JSON = """'{"name": "x", "dependencies": {"' || {clean} || '": "^1", "npm' || doc_id || '": "1"}'
  || case when doc_id % 3 = 0 then ', "devDependencies": {"dev' || doc_id || '": "2", "npm' || doc_id || '": "1"}' else '' end
  || case when doc_id % 5 = 4 then '' when doc_id % 11 = 5 then '} more' else '}' end""".replace("{clean}", _CLEAN)
PYPROJECT = """'[project]' || chr(10) || 'dependencies = ["lib' || doc_id || '>=1", "' || {clean} || '"]' || chr(10)
  || case when doc_id % 4 = 1 then '[tool.poetry.dependencies]' || chr(10) || 'python = "^3.11"' || chr(10)
     || 'poet' || doc_id || ' = "*"' || chr(10) else '' end
  || case when doc_id % 7 = 3 then 'broken = [' else '' end""".replace("{clean}", _CLEAN)
CLEAN = _CLEAN

# Rules of each source: one line per language and remainder it has, so at most 28.
IGNORE_LINE = """case m
  when 0 then '/' || lang || '/0/'
  when 1 then lang || '/1/*.md'
  when 2 then '!' || lang || '/2/main_*'
  when 3 then '*.log'
  when 4 then '!notes*4.log'
  when 5 then '**/5/**/Dockerfile'
  else case when lang = 'en' then 'build/' else '# about ' || lang end end"""
# The same rules as expressions over a path whose directories end in a slash.
IGNORE_RULE_REGEX = """case m
  when 0 then '^' || lang || '/0/$'
  when 1 then '^' || lang || '/1/[^/]*[.]md/?$'
  when 2 then '^' || lang || '/2/main_[^/]*/?$'
  when 3 then '^(.*/)?[^/]*[.]log/?$'
  when 4 then '^(.*/)?notes[^/]*4[.]log/?$'
  when 5 then '^(.*/)?5/(.*/)?Dockerfile/?$'
  else case when lang = 'en' then '^(.*/)?build/$' end end"""

# Scanner documents: one per lineitem and one per event.
DEP_SCAN = """'{"results": [{"packages": [{"package": {"name": "part' || l_partkey || '"'
  || case when l_linenumber % 3 = 0 then '' else ', "version": "1.' || l_linenumber || '"' end
  || '}, "vulnerabilities": [{"id": "V-' || l_suppkey || '", "summary": "' || l_returnflag || ' risk"'
  || case when l_linenumber % 2 = 0 then '' else ', "database_specific": {"severity": "' || l_linestatus || '"}' end
  || '}, {"summary": "second"}]}]}]' || case when l_orderkey % 11 = 0 then '' when l_orderkey % 17 = 0 then '} []' else '}' end"""
CODE_SCAN = """'{"results": [{"check_id": "rule.' || event_type || '", "path": "src/' || user_id || '.py"'
  || case when event_id % 3 = 0 then '' else ', "start": {"line": ' || (event_id % 500 + 1) || '}' end
  || case when event_id % 4 = 0 then '' else ', "extra": {"message": "found ' || event_type || '"'
     || case when event_id % 5 = 0 then '' else ', "severity": "ERROR"' end || '}' end
  || '}]' || case when event_id % 13 = 0 then ',' when event_id % 19 = 0 then '},{}' else '}' end"""
DEP_REPO = "'order' || (l_orderkey % 100)"
CODE_REPO = "'order' || (user_id % 100)"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share a given table out over all cores.

    Each test table is one file with one row group, which one task would read alone. Real
    tables come in many splits, so the engine has no such step.
    """
    files, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if files < cores else df


class Corpus:
    """Bound tables of one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table, table.columns[0])

    def part(self, source: str) -> DataFrame:
        """A table, or the rows of one that hold for a condition."""
        found = re.fullmatch(r"\(select \* from (\w+) where (.*)\)", source)
        return self.table(found[1]).where(found[2]) if found else self.table(source)

    @cached_property
    def raw_files(self) -> DataFrame:
        # Paths are made once per row; in a real table they are a plain column.
        parts = [
            compute_once(self.part(table), path=F.expr(path)).selectExpr(
                f"{repo} as repo", "path", f"{content} as content"
            )
            for table, repo, path, content in FILE_PARTS
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def files(self) -> DataFrame:
        return files_from_table(self.raw_files)

    @cached_property
    def modules(self) -> DataFrame:
        return files_from_table(self.table("documents").selectExpr(
            "source as repo", f"{MODULE_PATH} as path", f"{MODULE} as content", "doc_id"
        ))

    def manifests(self, name: str, content: str) -> DataFrame:
        return files_from_table(self.table("documents").selectExpr(
            "source || '-' || doc_id as repo", f"'{name}' as path", f"{content} as content"
        ))

    def rule_files(self, path: str, line: str) -> DataFrame:
        """A rule file per source, with one line per language and remainder it has."""
        kinds = self.table("documents").selectExpr("source", "lang", "doc_id % 7 as m").distinct()
        listed = F.array_sort(F.collect_list(F.struct("lang", "m", F.expr(line).alias("line"))))
        text = F.array_join(F.transform(listed, lambda s: s["line"]), "\n")
        return files_from_table(kinds.groupBy("source").agg(text.alias("content")).select(
            F.col("source").alias("repo"), F.lit(path).alias("path"), "content"
        ))

    @cached_property
    def ignoring(self) -> DataFrame:
        return self.files.unionByName(self.rule_files(".gitignore", IGNORE_LINE))

    @cached_property
    def lfs_rules(self) -> DataFrame:
        return self.rule_files(".gitattributes", LFS_LINE)

    @cached_property
    def dep_scans(self) -> DataFrame:
        return self.table("lineitem").selectExpr(f"{DEP_REPO} as repo", f"{DEP_SCAN} as json")

    @cached_property
    def code_scans(self) -> DataFrame:
        return self.table("events").selectExpr(f"{CODE_REPO} as repo", f"{CODE_SCAN} as json")


LFS_LINE = """case when m % 2 = 0 then lang || '/' || m || '/*.png filter=lfs diff=lfs -text'
  when m = 1 then '# filter=lfs note' when m = 3 then '*.txt text' else '  */' || lang || '/5/*.png   filter=lfs' end"""
LFS_REGEX = """case when m % 2 = 0 then '^' || lang || '/' || m || '/.*[.]png$'
  when m = 5 then '^.*/' || lang || '/5/.*[.]png$' end"""

# --- the same bindings for DuckDB -------------------------------------------------------

LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def sql_lines(x: str) -> str:
    """List of lines; the piece after the last line break is no line when it is empty."""
    pieces = f"regexp_split_to_array({x}, '{LINE_BREAK}')"
    return f"(case when {pieces}[-1] = '' then {pieces}[:-2] else {pieces} end)"


def sql_files(parts, name="files") -> str:
    """CTE with the columns of the files table, from (table, repo, path, content) rows."""
    union = " union all ".join(
        f"select {r} as repo, {p} as path, {c} as content from {t}" for t, r, p, c in parts
    )
    return f"""raw_{name} as ({union}),
named_{name} as (
  select repo, path, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as content,
    strlen(content) as disk_size, regexp_extract(path, '[^/]*$') as name,
    string_split(path, '/')[:-2] as dirs
  from raw_{name}),
{name} as (
  select *, lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) as suffix,
    array_to_string(dirs, '/') as dir, disk_size as size_bytes,
    array_to_string(list_concat(list_transform(dirs, lambda d: '0' || d), ['1' || name]), chr(0)) as walk_key
  from named_{name})"""


FILES = "with " + sql_files(FILE_PARTS)
MODULES = "with " + sql_files((("documents", "source", MODULE_PATH, MODULE),), "modules")
IGNORE_KINDS = "select distinct source, lang, doc_id % 7 as m from documents"


def sql_rule_part(path: str, line: str) -> tuple[str, str, str, str]:
    text = f"string_agg({line}, chr(10) order by lang, m)"
    table = f"(select source, {text} as rules from ({IGNORE_KINDS}) group by source)"
    return table, "source", f"'{path}'", "rules"


IGNORING = "with " + sql_files((*FILE_PARTS, sql_rule_part(".gitignore", IGNORE_LINE)))
ATTRIBUTED = "with " + sql_files((*FILE_PARTS, sql_rule_part(".gitattributes", LFS_LINE)))

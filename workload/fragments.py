"""SQL pieces that several checks share. Written from the rules, not from the Spark code."""

from srcframe.constants import (
    BINARY_SUFFIXES, GENERATED_MARKER, HASH_COMMENT_LANGUAGES, IMPORTANT_RULES, LANGUAGE_BY_KEY,
    NON_SOURCE_SUFFIXES, SLASH_COMMENT_LANGUAGES, SOURCE_SUFFIXES,
)
from workload.bindings import SPACE, sql_lines, sql_strip


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SPLIT = sql_lines("content")
_LANGS = ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_BY_KEY.items())

STATS = f"""langs(key, language) as (values {_LANGS}),
spoken as (
  select f.*, coalesce(n.language, s.language) as language, {SPLIT} as lines
  from files f left join langs n on n.key = f.name left join langs s on s.key = f.suffix),
stats as (
  select repo, path, walk_key, language, sha256(content) as content_hash,
    len(list_filter(bare, lambda l: l = '')) as blank,
    len(list_filter(bare, lambda l: mark <> '' and starts_with(l, mark))) as comment,
    len(lines) - blank - comment as code
  from (select *, list_transform(lines, lambda l: {sql_strip('l')}) as bare,
          case when language in {in_list(HASH_COMMENT_LANGUAGES)} then '#'
               when language in {in_list(SLASH_COMMENT_LANGUAGES)} then '//' else '' end as mark
        from spoken where language is not null))"""

MARKS = """marks as (
  select repo, path,
    len(list_filter(words, lambda w: upper(w) = 'TODO')) as todo_count,
    len(list_filter(words, lambda w: upper(w) = 'FIXME')) as fixme_count
  from (select repo, path, regexp_split_to_array(content, '[^\\p{L}\\p{N}_]+') as words from files))"""

TOKENS = r"len(regexp_extract_all({x}, '\p{{L}}+|\p{{N}}{{1,3}}|[^\t-\r \p{{L}}\p{{N}}]+'))"


def tokens(x: str) -> str:
    return TOKENS.format(x=x)


def distill(x: str) -> str:
    """The four clean-up steps, then the strip."""
    x = rf"regexp_replace({x}, '#[^\n]*', '', 'g')"
    x = f"""regexp_replace({x}, '"{{3}}(?s:.*?)"{{3}}', '\"\"\"...\"\"\"', 'g')"""
    x = f"regexp_replace({x}, '\\x27{{3}}(?s:.*?)\\x27{{3}}', '''''''...''''''', 'g')"
    x = rf"regexp_replace({x}, '\n[{SPACE}]*\n[{SPACE}]*', chr(10) || chr(10), 'g')"
    return sql_strip(x)


VISIBLE = "not list_contains(list_transform(list_append(dirs, name), lambda p: p[1] = '.'), true)"
UNIGNORED_DIRS = "not list_has_any(dirs, ['node_modules', '.git', '__pycache__'])"

PACKABLE = f"""packable as (
  select * from files where suffix not in {in_list(BINARY_SUFFIXES)}
    and disk_size > 0
    and not starts_with(content, '{GENERATED_MARKER}') and not contains(content, chr(0)))"""

DISTILLABLE = f"""distillable as (
  select * from files where suffix in {in_list(SOURCE_SUFFIXES)}
    and not contains(string_split(content, chr(10))[1], '{GENERATED_MARKER}')
    and not contains(content, chr(0)))"""


def greedy(budget: int, source: str = "candidates") -> str:
    """Chosen rows of ``source`` by one pass in density order, as a recursive query."""
    return f"""ranked as (
  select repo, path, cost, density,
    row_number() over (partition by repo order by density desc, walk_key) as n
  from {source} where cost > 0 and cost + 50 <= {budget}),
taking as (
  select repo, path, cost, density, n, true as taken, {budget} - cost - 50 as rest from ranked where n = 1
  union all
  select r.repo, r.path, r.cost, r.density, r.n, r.cost + 50 <= t.rest,
    case when r.cost + 50 <= t.rest then t.rest - r.cost - 50 else t.rest end
  from taking t join ranked r on r.repo = t.repo and r.n = t.n + 1),
picked as (
  select repo, path, cost, density, row_number() over (partition by repo order by n) as pick_order
  from taking where taken)"""


IMPORTANT = f"""lower(name) in {in_list(IMPORTANT_RULES['name'])}
  or suffix in {in_list(IMPORTANT_RULES['suffix'])}
  or {' or '.join(f"contains(lower(name), '{s}')" for s in IMPORTANT_RULES['substring'])}"""
NOT_SOURCE = in_list(NON_SOURCE_SUFFIXES)

# What the written modules measure to, derived from how they are written.
MODULE_FACTS = """facts as (
  select *, doc_id % 4 as k, 1 + length(text) - length(replace(text, chr(10), '')) as head,
    'lib/' || (doc_id % 3) || '/m' || doc_id || '.py' as path,
    '0lib' || chr(0) || '0' || (doc_id % 3) || chr(0) || '1m' || doc_id || '.py' as walk_key
  from documents where doc_id % 10 <> 9),
functions as (
  select source as repo, path, walk_key, 0 as ord, 'f' || doc_id as function_name,
    head + 1 as line_number, 1 + 2 * k as complexity_score from facts
  union all
  select source, path, walk_key, 1, 'g' || doc_id, head + 9 + 2 * k, 4 from facts),
metrics as (
  select source as repo, path, cast(2 as bigint) as function_count, 5 + 2 * k as total_complexity,
    (5 + 2 * k) / 2.0 as average_complexity,
    case when k = 0 then 0.0 else 6 * k * log2(5 + k) end as volume,
    case when k = 0 then 0.0 else 4 * k / (3.0 + k) * 6 * k * log2(5 + k) end as effort
  from facts)"""

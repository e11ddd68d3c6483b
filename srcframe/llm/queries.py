"""The registered queries of this folder, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcframe.llm import (
    blob_ledger, bpe_transducer, decontaminate, filter_audit, html_text, jaccard_join, line_dedup, maxscore, merkle_manifest,
    quality, suffix_dedup, token_counts, toxicity,
)
from srcframe.llm.common import STREAMED, load, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def vocabulary(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    done = bpe_transducer.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digest(load(spark, folder, "documents"))


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(load(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.classify(load(spark, folder, "documents"), load(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.classify(load(spark, folder, "documents"), load(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "weight", "words")


@query
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(load(spark, folder, "pages"))


@query
def op4_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.search(load(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


CHECKS["op4_maxscore"] = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
  from whole q join whole c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 10"""


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(load(spark, folder, "documents", **STREAMED), load(spark, folder, "benchmark"))


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup(load(spark, folder, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", "n_removed", F.char_length("text").cast("bigint").alias("n_kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.classes(load(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.dedup(load(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return blob_ledger.secrets(load(spark, folder, "documents"), shared_folder(spark, "ledger"))


# One branch for each rule, as patterns must be constants.
_MATCHES = " union all ".join(
    f"""select doc_id, {i} as place, '{r.kind}' as kind, {r.least} as least,
      regexp_extract_all(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') as matches,
      regexp_extract_all(t, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group}) as held,
      regexp_split_to_array(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') as gaps from texts"""
    for i, r in enumerate(blob_ledger.RULES))
CHECKS["op11_blob_ledger"] = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
hits as ({_MATCHES}),
pieces as (
  select doc_id, place, kind, least, unnest(range(1, len(matches) + 1)) as i, unnest(matches) as m, unnest(held) as h,
    unnest(gaps[:len(matches)]) as g from hits where len(matches) > 0),
placed as (
  select *, coalesce(sum(length(g) + length(m)) over (
    partition by doc_id, place order by i rows between unbounded preceding and 1 preceding), 0) + length(g) as s from pieces),
spans as (
  select doc_id, place, kind, s, kind || ':' || cast(s as bigint) || ':' || cast(s + length(m) as bigint) as span
  from placed where length(h) >= least)
select t.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
  count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(span, ',' order by s, place) filter (place < {len(blob_ledger.BASE)}), '')) as base_sha256,
  coalesce(string_agg(span, ',' order by s, place), '') as spans
from texts t left join spans p on p.doc_id = t.doc_id group by t.doc_id"""


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(load(spark, folder, "documents"), load(spark, folder, "labels"))


CHECKS["op12_filter_audit"] = r"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
fails as (
  select doc_id, part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(doc_id > min(doc_id) over (partition by t), false) as e from words),
marked as (
  select f.*, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic from fails f
  left join (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id) l
    on l.doc_id = f.doc_id),
kinds as (
  select part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as m, a::int + b::int + c::int + d::int + e::int as failing, good, toxic, count(*) as n
  from marked group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select p.x || q.x || r.x || s.x || t.x as o from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps as (select o, cast(k as int) as step, o[k] as letter, o[:k - 1] as earlier from orders, range(1, 6) r(k)),
met as (
  select k.*, s.*, m[letter] as fails,
    len(list_filter(string_split(earlier, ''), lambda y: y <> '' and coalesce(m[y], false))) > 0 as gone from kinds k, steps s),
counted as (
  select part, o as filter_order, step, letter,
    coalesce(sum(n) filter (not gone and not fails), 0) as kept, coalesce(sum(n) filter (not gone and fails), 0) as removed,
    coalesce(sum(n) filter (gone and fails), 0) as redundant, coalesce(sum(n) filter (fails and failing = 1), 0) as unique_fails,
    coalesce(sum(n) filter (not gone and fails and good), 0) as good_lost,
    coalesce(sum(n) filter (not gone and fails and toxic), 0) as toxic_lost
  from met group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley from counted"""


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    without_breaks = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    docs = load(spark, folder, "documents")
    return merkle_manifest.manifest(docs, F.when(even, without_breaks).otherwise(F.col("text")))


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || {0}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# DuckDB has no crc32: the usual table-free form, one byte of the decimal number at a time.
_CRC = """list_reduce([4294967295] || list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda k: ascii(cast(doc_id as varchar)[k])),
  lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end))"""


def _levels_sql(name: str, leaves: str) -> str:
    """Nodes level by level, then with the siblings before and after them, and those of the last level."""
    return f"""{name}(level, tree, i, h) as (
  select 0, tree, i, h from {leaves}
  union all
  select level + 1, tree, i // 3, sha256(string_agg(h, '' order by i))
  from (select *, count(*) over (partition by tree) as c from {name}) where c > 1 group by level, tree, i // 3),
{name}_tops as (select tree, max(level) as height, arg_max(h, level) as h from {name} group by tree),
{name}_steps as (
  select n.level, n.tree, n.i,
    coalesce(string_agg(n.h, '') over (partition by n.tree, n.level, n.i // 3 order by n.i rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(n.h, '') over (partition by n.tree, n.level, n.i // 3 order by n.i rows between 1 following and unbounded following), '') as r
  from {name} n join {name}_tops t on t.tree = n.tree and n.level < t.height)"""


CHECKS["op13_merkle_manifest"] = f"""
with recursive leaves as (
  select doc_id, coalesce('1' || source, '0') as tree, {_leaf_sql('text')} as h,
    case when xor(({_CRC}), 4294967295) % 2 = 0 then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql('text')} end as claim from documents),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as i from leaves),
{_levels_sql('nodes', 'placed')},
subroots as (select '' as tree, tree as name, h, row_number() over (order by tree) - 1 as i from nodes_tops),
{_levels_sql('above', 'subroots')},
walk(doc_id, tree, level, i, node, proof) as (
  select doc_id, tree, 0, i, claim, '' from placed
  union all
  select w.doc_id, w.tree, w.level + 1, w.i // 3, sha256(s.l || w.node || s.r), w.proof || s.l || s.r
  from walk w join nodes_steps s on s.tree = w.tree and s.level = w.level and s.i = w.i),
climb(doc_id, level, i, node, proof) as (
  select w.doc_id, 0, s.i, w.node, w.proof from walk w
  join nodes_tops t on t.tree = w.tree and t.height = w.level join subroots s on s.name = w.tree
  union all
  select c.doc_id, c.level + 1, c.i // 3, sha256(s.l || c.node || s.r), c.proof || s.l || s.r
  from climb c join above_steps s on s.level = c.level and s.i = c.i)
select p.doc_id, p.h as leaf, n.h as subroot, a.h as root, sha256(c.proof) as proof_sha256, c.node as folded_root, c.node = a.h as verified
from placed p join nodes_tops n on n.tree = p.tree join above_tops a on true
join climb c on c.doc_id = p.doc_id and c.level = a.height"""

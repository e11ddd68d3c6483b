"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes (a blob). The ledger is a
folder with two tables: ``scanned`` (which rule versions a blob was scanned with) and
``findings`` (the spans found, by blob and rule version). An update

1. addresses all given versions,
2. takes the pairs of blob and rule version that the ledger does not hold,
3. reads one text of each blob with such a pair and applies those rules to it,
4. appends the spans and then the pairs.

Findings are joined back to every place that holds the blob, so a copy costs no scan and a
new rule scans old blobs with that rule alone. A rule's version is a hash of its definition.

Only keys and blobs are shuffled to find what is unseen. The texts to scan meet that list by
(key, blob): in place where the list fits a broadcast, else by a shuffled hash join. A span's
place is the running sum of the lengths of the gaps and matches before it.

Defined results: null texts are empty. Rows without a key, or with a repeated one, are
versions like all others. An update that failed half way is repeated as a whole: spans
written twice are read once. An empty table adds nothing.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from srcframe.llm.common import stored
from srcframe.session import broadcast_if_small, compute_once, fits_broadcast


@dataclasses.dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def id(self) -> str:
        definition = repr((self.pattern, self.group, self.least))
        return f"{self.kind}@{hashlib.sha256(definition.encode()).hexdigest()[:12]}"


# The base rules, in the order they are listed in results. A run of letters
# that is too short is no start of a longer one, so two of them name the least length.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public formats that the base rules do not name.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE

SCANNED = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, start bigint, end bigint"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def addressed(versions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key`` and ``_blob`` of every row."""
    return versions.select(F.col(f"`{key}`").alias("_key"), blob_of(F.col(f"`{text}`")).alias("_blob"))


def read_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table of the ledger, empty before the first update."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def unseen(places: DataFrame, scanned: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``_key`` of one row for each blob, ``_blob`` and ``_todo``: the rules not applied to it yet."""
    ids = F.array(*[F.lit(r.id) for r in rules]).cast("array<string>")
    done = scanned.select(F.col("blob").alias("_blob"), F.explode("rules").alias("_rule")).groupBy("_blob").agg(
        F.collect_set("_rule").alias("_done"))
    blobs = places.groupBy("_blob").agg(F.min("_key").alias("_key"))
    todo = F.array_except(ids, F.coalesce("_done", F.array().cast("array<string>")))
    return blobs.join(done, "_blob", "left").select("_key", "_blob", todo.alias("_todo")).where(F.size("_todo") > 0)


def spans(texts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``blob``, ``rule``, ``start`` and ``end`` (in characters) in the rows ``_blob, _text, _todo``."""
    def hits(rule: Rule) -> Column:
        found = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(0))
        return F.struct(F.lit(rule.id).alias("rule"), F.when(F.array_contains("_todo", rule.id), found).alias("matches"))

    def by_rule(value) -> Column:
        out = F.lit(None)
        for rule in rules:
            out = F.when(F.col("rule") == rule.id, value(rule)).otherwise(out)
        return out

    def size_of(match: Column) -> Column:
        return by_rule(lambda r: F.char_length(F.regexp_extract(match, r.pattern, r.group) if r.group else match))

    all_hits = F.filter(F.array(*[hits(r) for r in rules]), lambda h: F.size(h["matches"]) > 0)
    # a row that repeats key and text is scanned by itself; its equal spans fall together later
    numbered = texts.withColumn("_row", F.monotonically_increasing_id())
    found = compute_once(numbered, _hits=all_hits).select("_row", "_blob", "_text", F.inline("_hits"))
    gaps = F.transform(by_rule(lambda r: F.split("_text", r.pattern, -1)), lambda g: F.char_length(g).cast("bigint"))
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size("matches")), "matches", lambda g, m: F.struct(
        g.alias("gap"), F.char_length(m).cast("bigint").alias("long"), size_of(m).alias("value")))
    pieces = compute_once(found, _pieces=pieces).select("_row", "_blob", "rule", F.posexplode("_pieces").alias("pos", "p"))
    before = Window.partitionBy("_row", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("p.gap") + F.col("p.long")).over(before), F.lit(0)) + F.col("p.gap")
    placed = pieces.withColumn("start", start).where(F.col("p.value") >= by_rule(lambda r: F.lit(r.least)))
    return placed.select(F.col("_blob").alias("blob"), "rule", "start", (F.col("start") + F.col("p.long")).alias("end"))


def update(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text",
           places: DataFrame | None = None) -> DataFrame:
    """Scan what the ledger in ``folder`` has not seen, and append it. Returns the new pairs.

    ``places`` may bring the stored result of :func:`addressed`.
    """
    spark = versions.sparkSession
    if places is None:
        places = stored(addressed(versions, key, text))
    fresh = stored(unseen(places, read_table(spark, f"{folder}/scanned", SCANNED), rules))
    texts = versions.select(
        F.col(f"`{key}`").alias("_t_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")
    ).withColumn("_t_blob", blob_of(F.col("_text")))
    listed = F.broadcast(fresh) if fits_broadcast(fresh) else fresh.hint("shuffle_hash")
    met = texts.join(listed, F.col("_t_key").eqNullSafe(F.col("_key")) & (F.col("_t_blob") == F.col("_blob")))
    found = spans(met.select("_blob", "_text", "_todo"), rules)
    found.distinct().write.mode("append").parquet(f"{folder}/findings")
    pairs = fresh.select(F.col("_blob").alias("blob"), F.col("_todo").alias("rules"))
    pairs.write.mode("append").parquet(f"{folder}/scanned")
    return pairs


def findings(spark: SparkSession, folder: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The spans that the ledger holds for these rule versions."""
    held = read_table(spark, f"{folder}/findings", FINDINGS)
    return held.where(F.col("rule").isin(*[r.id for r in rules])).distinct()


def at_places(places: DataFrame, found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``_key``, ``_found`` (array of ``start, place, end, kind`` in order, may be null) for every row of ``places``."""
    place = F.lit(None).cast("int")
    for i, rule in enumerate(rules):
        place = F.when(F.col("rule") == rule.id, i).otherwise(place)
    row = F.struct("start", place.alias("place"), "end", F.substring_index("rule", "@", 1).alias("kind"))
    by_blob = stored(found.groupBy(F.col("blob").alias("_blob")).agg(F.array_sort(F.collect_list(row)).alias("_found")))
    return places.join(broadcast_if_small(by_blob), "_blob", "left").select("_key", "_found")


def listed(found: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Update the ledger in ``folder`` and give ``key``, counts of the base kinds, and the spans of every row."""
    places = stored(addressed(versions, key, text))
    update(versions, folder, rules, key, text, places)
    held = at_places(places, findings(versions.sparkSession, folder, rules), rules)
    held = held.withColumn("_found", F.coalesce("_found", F.array().cast(held.schema["_found"].dataType)))
    base = [r.kind for r in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    in_base = F.filter("_found", lambda s: s["kind"].isin(*base))
    return held.select(
        F.col("_key").alias(key), *counts, F.sha2(listed(in_base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("_found")).alias("spans"))

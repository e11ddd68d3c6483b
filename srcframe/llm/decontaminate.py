"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: a number, a name (a capitalised word inside a sentence) and a unit
(a unit word after a number) become a typed placeholder, other words are lower-cased. Every
window of ``window`` template words of a benchmark item is hashed and joined with the
windows of all documents, so an item whose numbers, names or units were exchanged is found
as well. Windows of one document that lie on one diagonal of an item (same difference of
positions) belong together. White space is one blank, whatever it was. A window with a name
also has a second, case-folded hash with the name as a word, so a copy in other case is found
by its words.

Where a name was exchanged, each name of the item must stand for one name of the document
throughout the diagonal; if not, only the diagonal's windows with no exchanged name count.
A number or a unit may stand for several things in a long text, so these are judged window by
window: where one value of the item would be two values of the document within a window, the
window does not count. A document leaks an item when the windows that count cover
``least_share`` of the item's windows.

An item with fewer words than a window is one window of all its words. Windows with fewer
than ``literals`` words that are no placeholders are left out, unless fewer than
``least_share`` of the item's windows would be left; then all are used. On a diagonal that
has only such windows they count where they hold that many literal words together, or where
the document has the item's own values.

Defined results: null and empty texts have no window. Rows of the same key count as parts of
one text: their windows add up. Rows without a key, of documents and of items, take no part in
:func:`leaks`; :func:`clean` keeps such documents. Empty tables have no leaks.
"""

from __future__ import annotations

import dataclasses
import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.llm.common import stored
from srcframe.session import broadcast_if_small, compute_once


@dataclasses.dataclass(frozen=True)
class Settings:
    window: int = 8
    # words of a window, or of a diagonal, that must be no placeholders
    literals: int = 4
    least_share: float = 0.5


# One private-use character for each kind of slot; such characters are blanks in a text.
NUMBER, NAME, UNIT = "", "", ""
SLOTS = NUMBER + NAME + UNIT

# Unit words.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ml cl l s sec second "
    "seconds min minute minutes h hr hour hours day days week weeks month months year years percent pct usd eur "
    "dollar dollars cent cents euro euros pound pounds degree degrees c f k kb mb gb tb w kw kwh v hz khz mhz ghz "
    "kmh mph pa kpa meter meters metre metres gram grams kilogram kilograms liter liters litre litres"
).split()

_WORD = r"[\p{L}\p{M}]+"
_FIGURE = r"\p{N}+(?:[.,]\p{N}+)*"
_NAME = r"(?<=[\p{Ll}\p{N},;:]\s)\p{Lu}\p{Ll}[\p{L}\p{M}]*+"


def _clean(text: Column) -> Column:
    blank = F.translate(F.coalesce(text, F.lit("")), SLOTS, "   ")
    return F.regexp_replace(blank, r"[\s\p{Z}]+", " ")


def raw_words(text: Column) -> Column:
    """The words and figures as they stand, one for each template word."""
    return F.regexp_extract_all(_clean(text), F.lit(f"{_WORD}|{_FIGURE}"), F.lit(0))


def template_words(text: Column, names: bool = True) -> Column:
    """Words and slots; without ``names`` these are words like others."""
    named = F.regexp_replace(_clean(text), _NAME, NAME) if names else _clean(text)
    counted = F.lower(F.regexp_replace(named, _FIGURE, NUMBER))
    units = "|".join(UNITS)
    measured = F.regexp_replace(counted, rf"(?<={NUMBER}\s?)(?:{units})(?![\p{{L}}\p{{M}}])", UNIT)
    return F.regexp_extract_all(measured, F.lit(f"{_WORD}|[{SLOTS}]"), F.lit(0))


def _windows(table: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """``id``, place ``at``, ``size`` and ``hash`` of each window, and the word arrays it lies in.

    A window with a name has two rows, one with the name as a slot and one with it as a word.
    """
    narrow = table.select(F.col(key).alias("id"), F.col(text).alias("_text")).where(F.col("id").isNotNull())
    made = compute_once(narrow, words=template_words(F.col("_text")), raw=raw_words(F.col("_text")))
    folded = F.when(F.array_contains("words", NAME), template_words(F.col("_text"), names=False)).otherwise(F.col("words"))
    made = compute_once(made, folded=folded).drop("_text")
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    spread = made.select("*", F.explode(places).alias("at"))
    hashed = []
    for size in sizes:
        inside = F.col("at") + size <= F.size("words")
        words, plain = ([F.get(c, F.col("at") + i) for i in range(size)] for c in ("words", "folded"))
        named = functools.reduce(operator.or_, [w == NAME for w in words])
        for valid, held in ((inside, words), (inside & named, plain)):
            hashed.append(F.struct(F.lit(size).alias("size"), F.when(valid, F.xxhash64(F.lit(size), *held)).alias("hash")))
    return spread.select("*", F.inline(F.array(*hashed))).where(F.col("hash").isNotNull())


def benchmark_windows(benchmark: DataFrame, settings: Settings, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``item_at``, ``size``, ``hash``, the window's ``kinds`` of slots and raw ``values``,
    and ``strong``: whether it holds literal words enough."""
    full = settings.window
    windows = _windows(benchmark, key, text, list(range(1, full + 1)))
    windows = windows.where(F.col("size") == F.least(F.lit(full), F.size("words")))
    window = F.slice("words", F.col("at") + 1, F.col("size"))
    kinds = F.transform(window, lambda w: F.when(F.instr(F.lit(SLOTS), w) > 0, w))
    made = windows.select(
        F.col("id").alias("item_id"), F.col("at").alias("item_at"), "size", "hash", kinds.alias("kinds"),
        F.transform(F.slice("raw", F.col("at") + 1, F.col("size")), F.lower).alias("values"))
    made = stored(made.withColumn("strong", F.size(F.filter("kinds", lambda k: k.isNull())) >= settings.literals))
    whole = made.groupBy("item_id").agg(F.countDistinct("item_at").alias("_all"), F.countDistinct(F.when(F.col("strong"), F.col("item_at"))).alias("_strong"))
    whole = whole.select("item_id", (F.col("_strong") < settings.least_share * F.col("_all")).alias("_weak"))
    return made.join(broadcast_if_small(whole), "item_id").where(F.col("strong") | F.col("_weak")).drop("_weak")


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item it leaks: ``key``, ``item_id``, ``n_matched``,
    ``n_windows`` and ``coverage``.

    The windows of the items are broadcast when their counted size allows it, so those of the
    documents are tested where the texts are read. Otherwise both sides meet by hash.
    """
    items = stored(benchmark_windows(benchmark, settings))
    sizes = items.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"))
    # at most as many rows as a window has words
    lengths = sorted(r["size"] for r in items.select("size").distinct().collect()) or [settings.window]
    windows = _windows(docs, key, text, lengths)
    has_slot = F.exists("kinds", lambda k: k.isNotNull())
    met = windows.join(broadcast_if_small(items), ["size", "hash"]).select(
        "id", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), "strong", "kinds", "values",
        F.when(has_slot, F.transform(F.slice("raw", F.col("at") + 1, F.col("size")), F.lower)).alias("given"))
    pairs = F.zip_with(
        F.zip_with("kinds", "values", lambda k, v: F.when(k == NAME, v)), F.col("given"),
        lambda v, d: F.struct(v.alias("item"), d.alias("doc")))
    literal = F.filter(F.transform("kinds", lambda k, i: F.when(k.isNull(), F.col("item_at") + i)), lambda i: i.isNotNull())
    names = F.filter(pairs, lambda p: p["item"].isNotNull())
    exact = F.col("given").isNull() | (F.col("given") == F.col("values"))
    exchanged = F.coalesce(F.exists(names, lambda p: p["item"] != p["doc"]), F.lit(False))
    values_of = F.zip_with("kinds", "values", lambda k, v: F.when(k.isin(NUMBER, UNIT), F.concat(k, v)))
    slots = F.filter(
        F.zip_with(values_of, F.col("given"), lambda v, d: F.struct(v.alias("item"), d.alias("doc"))), lambda p: p["item"].isNotNull())
    # one value of the item is one value of the document
    agreed = F.coalesce(
        F.size(F.array_distinct(slots)) == F.size(F.array_distinct(F.transform(slots, lambda p: p["item"]))), F.lit(True))
    met = met.select(
        "id", "item_id", "diagonal", "strong",
        F.struct("item_at", exact.alias("exact"), exchanged.alias("exchanged"), agreed.alias("agreed")).alias("place"),
        names.alias("pairs"),
        F.when(~F.col("strong"), literal).alias("literal"))
    diagonals = met.groupBy("id", "item_id", "diagonal").agg(
        F.collect_set("place").alias("places"), F.max("strong").alias("strong"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.size(F.array_distinct(F.flatten(F.collect_set("literal")))).alias("literals"))
    values = F.array_distinct(F.transform("pairs", lambda p: p["item"]))
    judged = diagonals.select(
        "id", "item_id", "places", (F.size("pairs") == F.size(values)).alias("consistent"),
        (F.col("strong") | (F.col("literals") >= settings.literals)).alias("enough"))
    counted = F.filter("places", lambda p: p["exact"] | (F.col("enough") & p["agreed"] & (F.col("consistent") | ~p["exchanged"])))
    covered = (
        judged.select("id", "item_id", F.explode(F.transform(counted, lambda p: p["item_at"])).alias("item_at")).distinct()
        .groupBy("id", "item_id").agg(F.count("*").alias("n_matched"))
    )
    found = covered.join(broadcast_if_small(sizes), "item_id").withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return found.where(F.col("coverage") >= settings.least_share).select(
        F.col("id").alias(key), "item_id", "n_matched", "n_windows", "coverage")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that leak an item; rows without a key stay."""
    found = stored(leaks(docs, benchmark, settings, key, text).select(key).distinct())
    return docs.join(broadcast_if_small(found), key, "left_anti")

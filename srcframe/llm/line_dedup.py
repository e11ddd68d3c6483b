"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its lines that are not blank, each with a hash (of the
trimmed line) and a number of words. A window is a line with the least number of lines
after it, or before it, that together hold ``least_words`` words. The line with the smallest
hash in a window is its fingerprint, so neighbouring windows mostly share one.

1. Every window brings its fingerprint's position, keyed by the hash of the window's lines.
   The key makes the fingerprint guaranteed: two places that hold the same window meet,
   however often the line itself stands elsewhere.
2. A position is joined with the first one of its key, in order of (document, line).
   Equal pairs of positions fall together, and there are about as many as fingerprints.
3. From each pair the match is extended both ways, line by line, over the ``least_words``
   lines on either side. The lines of the later place that agree are deleted.

A line lies in a repeated run of that many words just if it lies in a repeated window:
shorten the run at both ends as long as it holds the line and the words, and what is left is
a window. A window has no more than ``least_words`` lines, so the extension covers it; and
all lines of an extension lie in windows that stand at the earlier place too. So exactly the
lines of later repeated runs go.

Only narrow rows (keys, places, line hashes) are shuffled; the deleted places of a document
then meet its text. The most frequent window of all is one group of narrow rows, reduced in
tasks first, and its joins are split by adaptive execution.

Defined results: null texts are empty. Blank lines stay. Rows of the same key and text are
the same document; rows without a key are left as they are. All input columns stay; a result
whose name one of them has gets underscores before its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.llm.common import own_name, stored
from srcframe.session import broadcast_if_small, compute_once

LEAST_WORDS = 8


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\f\v", "    "))


def _sequence(text: Column) -> Column:
    """Hash ``h`` and number of words ``w`` of the lines that are not blank."""
    lines = F.filter(F.transform(split_lines(text), _trimmed), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " +")).alias("w")))


def _reach(words: Column, least: int) -> Column:
    """How many of the lines it takes to hold ``least`` words; all and one more if they hold less."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("words"))
    end = F.aggregate(words, start, lambda s, w: F.when(s["words"] >= least, s).otherwise(
        F.struct((s["n"] + 1).alias("n"), (s["words"] + w).alias("words"))),
        lambda s: F.when(s["words"] >= least, s["n"]).otherwise(s["n"] + 1))
    return F.when(F.get(words, F.lit(0)) >= least, 1).otherwise(end)


def _code(at: Column, n: Column, least: int) -> Column:
    """A window as one number: no window has more than ``least`` lines."""
    return at.cast("bigint") * (least + 1) + n


def _start(code: Column, least: int) -> Column:
    return F.floor(code / (least + 1)).cast("int")


def _length(code: Column, least: int) -> Column:
    return (code % (least + 1)).cast("int")


def _windows(words: Column, least: int) -> Column:
    """The windows of the lines with these numbers of words, each once."""
    def after(i: Column) -> Column:
        n = _reach(F.slice(words, i + 1, least), least)
        return F.filter(F.array(n), lambda n: i + n <= F.size(words))

    def before(i: Column) -> Column:
        held = F.least(i + 1, F.lit(least))
        n = _reach(F.reverse(F.slice(words, i - held + 2, held)), least)
        return F.filter(F.array(n), lambda n: n <= i + 1)

    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))
    ahead = F.transform(places, lambda i: F.transform(after(i), lambda n: _code(i, n, least)))
    back = F.transform(places, lambda i: F.transform(before(i), lambda n: _code(i - n + 1, n, least)))
    return F.array_union(F.flatten(ahead), F.flatten(back))


def _document(key: str, text: str) -> Column:
    return F.struct(F.col(f"`{key}`").cast("bigint").alias("id"), F.xxhash64(f"`{text}`").alias("text_hash"))


def sequences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, and ``hashes`` and ``words`` of its lines that are not blank."""
    named = docs.where(F.col(f"`{key}`").isNotNull()).select(_document(key, text).alias("doc"), F.col(f"`{text}`").alias("_text"))
    made = compute_once(named, seq=_sequence(F.col("_text"))).where(F.size("seq") > 0)
    return made.select("doc", F.col("seq.h").alias("hashes"), F.col("seq.w").alias("words"))


def fingerprints(seqs: DataFrame, least: int) -> DataFrame:
    """``group`` (hash of a window's lines), ``doc``, ``at`` (the window's first line) and
    ``print`` (its line with the smallest hash) of every window."""
    made = compute_once(seqs, codes=_windows(F.col("words"), least))

    def found(code: Column) -> Column:
        window = F.slice("hashes", _start(code, least) + 1, _length(code, least))
        smallest = F.array_position(window, F.array_min(window)).cast("int") - 1
        return F.struct(
            F.xxhash64(window).alias("group"), _start(code, least).alias("at"), (_start(code, least) + smallest).alias("print"))

    return made.select("doc", F.inline(F.transform("codes", found))).select("group", "doc", "at", "print")


def position_pairs(prints: DataFrame) -> DataFrame:
    """``doc``, ``print`` and the first place ``first, first_print`` of a window that chose it there as well."""
    place = F.struct("doc", "at", "print")
    first = stored(
        prints.groupBy("group").agg(F.min(place).alias("low"), F.max(place).alias("high"))
        .where(F.col("low") != F.col("high")).select("group", "low"))
    later = prints.join(first, "group").where(place != F.col("low"))
    return later.select(
        "doc", "print", F.col("low.doc").alias("first"), F.col("low.print").alias("first_print")).distinct()


def surroundings(seqs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """``doc`` and ``print`` of ``places``, with the lines from the fingerprint on (``ahead``) and
    those before it, nearest first (``back``)."""
    wanted = places.groupBy("doc").agg(F.collect_set("print").alias("prints"))
    held = seqs.join(broadcast_if_small(stored(wanted)), "doc").select("doc", "hashes", "words", F.explode("prints").alias("print"))
    held = held.withColumn("_before", F.least("print", F.lit(least)))
    around = lambda c: (
        F.slice(c, F.col("print") + 1, F.lit(least)), F.reverse(F.slice(c, F.col("print") - F.col("_before") + 1, F.col("_before"))))
    (ahead, back), (w_ahead, w_back) = around("hashes"), around("words")
    return held.select("doc", "print", ahead.alias("ahead"), back.alias("back"), w_ahead.alias("w_ahead"), w_back.alias("w_back")).distinct()


def _agreeing(mine: Column, its: Column) -> Column:
    """How many lines agree from the beginning on."""
    same = F.zip_with(mine, its, lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False).cast("int")
    return F.when(differs == 0, F.size(mine)).otherwise(differs - 1)


def extended(pairs: DataFrame, seqs: DataFrame, least: int) -> DataFrame:
    """``doc``, ``from`` and ``to`` (exclusive) of the lines at a later place that agree with an earlier one."""
    mine = surroundings(seqs, pairs.select("doc", "print").distinct(), least)
    its = surroundings(seqs, pairs.select(F.col("first").alias("doc"), F.col("first_print").alias("print")).distinct(), least)
    its = stored(its.select(
        F.col("doc").alias("first"), F.col("print").alias("first_print"), F.col("ahead").alias("f_ahead"), F.col("back").alias("f_back")))
    met = pairs.join(mine, ["doc", "print"]).join(broadcast_if_small(its), ["first", "first_print"])
    met = compute_once(
        met, _ahead=_agreeing(F.col("ahead"), F.col("f_ahead")), _back=_agreeing(F.col("back"), F.col("f_back")))
    total = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0).cast("bigint"), lambda s, w: s + w)
    words = total("w_ahead", F.col("_ahead")) + total("w_back", F.col("_back"))
    return met.where((F.col("_ahead") > 0) & (words >= least)).select(
        "doc", (F.col("print") - F.col("_back")).alias("from"), (F.col("print") + F.col("_ahead")).alias("to"))


def repeated_places(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``doc`` and ``places``: which of its lines that are not blank are deleted."""
    seqs = stored(sequences(docs, key, text))
    pairs = stored(position_pairs(stored(fingerprints(seqs, least))))
    runs = extended(pairs, seqs, least)
    held = runs.groupBy("doc").agg(F.collect_set(F.struct("from", "to")).alias("runs"))
    lines = F.transform("runs", lambda r: F.sequence(r["from"], r["to"] - 1))
    return held.select("doc", F.array_distinct(F.flatten(lines)).alias("places"))


def result_names(docs: DataFrame) -> tuple[str, str]:
    """The names of the two counts in the result of :func:`dedup`."""
    return own_name(docs, "n_lines"), own_name(docs, "n_removed")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines`` and ``n_removed`` (lines that are not blank)."""
    found = stored(repeated_places(docs, key, text, least))
    n_lines, n_removed = result_names(docs)
    # the columns of the table travel as one, so that no name of theirs meets one of ours
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _document(key, text).alias("doc"))
    joined = whole.join(broadcast_if_small(found), "doc", "left")
    body = F.col("row").getField(text)
    lines = split_lines(body)
    held = F.filter(F.transform(lines, lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull())
    made = compute_once(joined, lines=lines, held=held)
    made = compute_once(made, gone=F.transform("places", lambda p: F.get("held", p)))
    kept = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("places").isNull(), F.coalesce(body, F.lit(""))).otherwise(kept)
    return made.select(
        *[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns],
        F.size("held").cast("bigint").alias(n_lines), F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias(n_removed))

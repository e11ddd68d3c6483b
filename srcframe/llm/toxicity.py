"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and digits that
stand for letters become the letters, everything else between words becomes one blank. A
lexicon entry is the beginning of a word, or a whole word, with a weight. An exception is a
phrase of two whole words: an entry's match inside it does not count. The weights of the matches in
a text, by number and by share of its words, give the score through a logistic curve.

Entries, weights, exceptions and the curve are learned from a bounded sample of labelled
documents (see :class:`Settings`): an entry must be much more frequent in toxic texts, an
exception occur only in others.

Defined results: null and empty texts have no match; they and all texts without a match
get the score of the curve at zero. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame, functions as F

from srcframe.llm.common import map_texts, stored
from srcframe.llm.labelled import held_out, known_labels, training_texts


@dataclasses.dataclass(frozen=True)
class Settings:
    per_class: int = 3000
    # lengths of word beginnings that may become entries
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    # fewest documents with an entry or exception, and least log of the ratio of an entry's
    # frequencies, after ``errors`` standard errors were taken off
    least_documents: int = 5
    least_weight: float = 1.5
    errors: float = 1.5


# Letters of other scripts, and digits, that are read as a Latin letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ѵ": "v", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a"}


class Folder(dict):
    """A table for ``str.translate`` that works out a character when it is first met."""

    def __missing__(self, code: int) -> str:
        import unicodedata

        # full-width and styled letters have a plain form; accents stay
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        folded = "".join(LOOKALIKES.get(c, c) for c in plain)
        folded = folded if all(c.isalpha() for c in folded) else DIGITS.get(plain, " ")
        self[code] = folded
        return folded


def fold(text: str, folder: Folder) -> str:
    """The folded words, each after one blank, and a blank at the end; '' without a word."""
    words = text.translate(folder).split()
    return f" {' '.join(words)} " if words else ""


def _seen(text: str, folder: Folder, settings: Settings) -> tuple[set[str], set[str]]:
    """Possible entries and exceptions of one text."""
    words = fold(text, folder).split()
    entries = set()
    for word in set(words):
        entries.update(f" {word[:n]}" for n in settings.beginnings if len(word) >= n)
        entries.add(f" {word} ")
    return entries, {f" {a} {b} " for a, b in zip(words, words[1:])}


def _frequencies(sample: DataFrame, kind: int, settings: Settings) -> DataFrame:
    """In how many documents of either label each string occurs, added up in tasks first."""
    def run(batches):
        import collections

        import pyarrow as pa

        folder = Folder()
        counts = collections.Counter()
        for batch in batches:
            for label, text in zip(batch.column("_label").to_pylist(), batch.column("_text").to_pylist()):
                for found in _seen(text or "", folder, settings)[kind]:
                    counts[found, label] += 1
        rows = sorted(counts.items())
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()),
            pa.array([n for _, n in rows], pa.int64()),
        ], names=["entry", "label", "n"])

    counted = sample.mapInArrow(run, "entry string, label int, n bigint")
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    return counted.groupBy("entry").agg(of(1).alias("toxic"), of(0).alias("other"))


class Matcher:
    """The automaton over entries and exceptions."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), 0.0, True))
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight, False))
        self.automaton.make_automaton()
        self.empty = not (lexicon or exceptions)
        self.folder = Folder()

    def measure(self, text: str) -> tuple[float, int]:
        """Weights of the matches, one at each word beginning, and the number of words."""
        folded = fold(text, self.folder)
        if not folded or self.empty:
            return 0.0, max(0, folded.count(" ") - 1)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight, spare) in self.automaton.iter(folded):
            start = end + 1 - length
            if spare:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        # matches begin at a blank; a phrase ends with the blank of the next word
        free = {start for first, last in spared for start in best if first <= start < last} if spared else ()
        return sum(w for start, w in best.items() if start not in free), folded.count(" ") - 1


def curve_inputs(weight: float, words: int) -> tuple[float, float]:
    """What the curve is a function of: share of the words and, less steeply, the amount."""
    return math.log1p(100 * weight / words) if words else 0.0, math.log1p(weight)


def fit_curve(rows: list[tuple[int, float, int]]) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    import numpy as np

    if len({r[0] for r in rows}) < 2:
        return -50.0, 0.0, 0.0
    x = np.array([(1.0, *curve_inputs(w, n)) for _, w, n in rows])
    y = np.array([label for label, _, _ in rows], float)
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + ridge @ beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, slope)
        beta -= step
        if abs(step).max() < 1e-6:
            break
    return tuple(map(float, beta))


@dataclasses.dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float, float]


def fit(docs: DataFrame, labels: DataFrame, held, settings: Settings = Settings(), label: str = "toxic") -> Model:
    """Learn from at most ``2 * per_class`` documents; the driver gets bounded lists only."""
    # at most 2 * per_class texts, read by four steps
    sample = stored(training_texts(docs, labels, label, held, settings.per_class))
    sizes = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return Model({}, [], (-50.0, 0.0, 0.0))
    weight = F.log(((F.col("toxic") + 0.5) / sizes[1]) / ((F.col("other") + 0.5) / sizes[0]))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    found = (
        _frequencies(sample, 0, settings).withColumn("weight", weight)
        .where((F.col("toxic") >= settings.least_documents) & (F.col("weight") - settings.errors * error >= settings.least_weight))
        .orderBy("entry")
    )
    # every string that passes both bounds; the sample bounds their number
    lexicon = {r["entry"]: r["weight"] for r in found.select("entry", "weight").collect()}
    begins = Matcher(lexicon, [])
    phrases = (
        _frequencies(sample, 1, settings).where((F.col("toxic") == 0) & (F.col("other") >= settings.least_documents))
    )

    def make():
        return lambda texts: [[begins.measure(t)[0] > 0 for t in texts]]

    phrases = map_texts(phrases, "entry", make, "hit boolean", ("entry", "other")).where("hit")
    exceptions = [r[0] for r in phrases.orderBy("entry").collect()]
    measured = measure(sample, lexicon, exceptions, "_text", ("_label",))
    rows = sorted((r[0], r[1], r[2]) for r in measured.collect())
    bias, *slopes = fit_curve(rows)
    # the sample has more toxic documents than the labels have; the curve is for the latter
    share = {r[0]: r[1] for r in known_labels(labels, label, held).groupBy("_label").count().collect()}
    bias += math.log(share[1] / share[0] * sizes[0] / sizes[1])
    return Model(lexicon, exceptions, (bias, *slopes))


def measure(docs: DataFrame, lexicon: dict[str, float], exceptions: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``weight`` of all matches and ``words`` of every whole text, in place."""
    def make():
        matcher = Matcher(lexicon, exceptions)

        def work(texts):
            rows = [matcher.measure(t) for t in texts]
            return [r[0] for r in rows], [r[1] for r in rows]

        return work

    return map_texts(docs, text, make, "weight double, words bigint", keep)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``weight``, ``words``, ``score`` and ``predicted``."""
    bias, share, amount = model.curve
    x = F.when(F.col("words") > 0, F.log1p(100 * F.col("weight") / F.col("words"))).otherwise(0.0)
    margin = F.lit(bias) + share * x + amount * F.log1p("weight")
    scored = measure(docs, model.lexicon, model.exceptions, text, keep).withColumn("score", 1 / (1 + F.exp(-margin)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), modulus: int = 3, rest: int = 1, threshold: float = 0.7) -> DataFrame:
    """Fit on the labels outside the held-out part and score every document."""
    model = fit(docs, labels, held_out("doc_id", modulus, rest), settings)
    return score(docs, model, threshold).withColumn("held_out", held_out("doc_id", modulus, rest))

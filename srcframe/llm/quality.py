"""Quality classifier: supervised subword embeddings.

A document is the bag of its words and of the character n-grams of each word. Each of
these has a learned vector in a hashed table; the document's vector is their mean, and a
softmax over it gives the class. Table and output weights are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled documents. As the
mean and the output are linear, a trained table shrinks to one number per bucket, which is
what the scoring tasks get.

A word equal to the one before it counts once more as a feature of its own, the n-gram
``w w`` with the word left open.

Defined results: null and empty texts have no feature; they get the score of the output's
bias alone. Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, functions as F

from srcframe.llm.common import map_texts, own_name, per_worker, trim_memory
from srcframe.llm.labelled import held_out, training_texts
from srcframe.llm.words import WordTable


@dataclasses.dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dimensions: int = 12
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 12
    rate: float = 0.5
    per_class: int = 1500
    seed: int = 7
    # words a scoring task remembers; only saves time
    remembered: int = 100_000


REPEATED = "\0="


def buckets_of(word: str, settings: Settings) -> list[int]:
    from zlib import crc32

    mask = settings.buckets - 1
    held = f"<{word}>"
    found = [crc32(held.encode("utf-8", "surrogatepass")) & mask]
    for n in settings.grams:
        found += [crc32(held[i:i + n].encode("utf-8", "surrogatepass")) & mask for i in range(len(held) - n + 1)]
    return found


def repeats(words: list[str]) -> int:
    import operator

    return sum(map(operator.eq, words, words[1:]))


def features(text: str, settings: Settings):
    """Bucket numbers and how often each occurs."""
    import collections

    import numpy as np

    words = text.split()
    counts: dict[int, int] = collections.Counter()
    for word, times in collections.Counter(words).items():
        for bucket in buckets_of(word, settings):
            counts[bucket] += times
    if again := repeats(words):
        counts[buckets_of(REPEATED, settings)[0]] += again
    return np.fromiter(counts.keys(), "<i4", len(counts)), np.fromiter(counts.values(), "<f4", len(counts))


def train(samples: list[tuple[int, bytes, bytes]], settings: Settings):
    """The margin of class 1 over class 0: one number per bucket, and the bias."""
    import numpy as np

    margin = np.zeros(settings.buckets)
    if len({label for label, _, _ in samples}) < 2:
        return margin, 0.0
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1, 1, (settings.buckets, settings.dimensions)) / settings.dimensions
    weights, bias = np.zeros((settings.dimensions, 2)), np.zeros(2)
    docs = []
    for label, ids, counts in samples:
        ids, counts = np.frombuffer(ids, "<i4"), np.frombuffer(counts, "<f4")
        if len(ids):
            docs.append((label, ids, (counts / counts.sum())[:, None]))
    steps, done = settings.epochs * len(docs), 0
    for _ in range(settings.epochs):
        for at in rng.permutation(len(docs)):
            label, ids, share = docs[at]
            rate = settings.rate * (1 - done / steps)
            done += 1
            vectors = table[ids]
            hidden = (vectors * share).sum(0)
            logits = hidden @ weights + bias
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[label] -= 1
            back = weights @ wrong
            weights -= rate * np.outer(hidden, wrong)
            bias -= rate * wrong
            # a bucket's share is small, so its step is scaled up to the size of a word's
            table[ids] = vectors - rate * np.minimum(1, share * 50) * back
    margin = table @ (weights[:, 1] - weights[:, 0])
    return margin, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, held, settings: Settings = Settings(), label: str = "quality"):
    """Train on at most ``2 * per_class`` documents; features are made where the texts are."""
    chosen = training_texts(docs, labels, label, held, settings.per_class)

    def make():
        def work(texts):
            made = [features(t, settings) for t in texts]
            return [ids.tobytes() for ids, _ in made], [counts.tobytes() for _, counts in made]

        return work

    made = map_texts(chosen, "_text", make, "ids binary, counts binary", ("_label",))
    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in made.collect())
    model = train(rows, settings)
    rows.clear()
    trim_memory()  # the features of the sample are no longer needed by the driver
    return model


def result_names(keep) -> tuple[str, str]:
    """The names of :func:`score`'s two results: underscores go before a name that is kept."""
    return own_name(keep, "score"), own_name(keep, "predicted")


def score(docs: DataFrame, model, settings: Settings = Settings(), threshold: float = 0.3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every whole text, in place."""
    named, predicted = result_names(keep)
    margin, bias = model
    packed = margin.astype("<f4").tobytes()
    sent, name = docs.sparkSession.sparkContext.broadcast(packed), hash((packed, bias, settings))

    def make():
        import numpy as np

        weight = np.frombuffer(sent.value, "<f4").tolist()

        def of(word):
            found = buckets_of(word, settings)
            # the sum of the weights, and as the imaginary part their number
            return complex(sum([weight[b] for b in found]), len(found))

        table = per_worker(("quality", name), lambda: WordTable(of, settings.remembered))
        again = weight[buckets_of(REPEATED, settings)[0]]

        def one(text):
            words = text.split()
            total = sum(map(table.__getitem__, words), 0j)
            more = repeats(words)
            count = total.imag + more
            margin = bias + ((total.real + again * more) / count if count else 0.0)
            return float(1 / (1 + np.exp(-margin)))

        return lambda texts: [[one(t) for t in texts]]

    scored = map_texts(docs, text, make, f"`{named}` double", keep)
    return scored.withColumn(predicted, (F.col(f"`{named}`") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), modulus: int = 5, rest: int = 0, threshold: float = 0.3) -> DataFrame:
    """Fit on the labels outside the held-out part and score every document."""
    model = fit(docs, labels, held_out("doc_id", modulus, rest), settings)
    scored = score(docs, model, settings, threshold)
    return scored.withColumn("held_out", held_out("doc_id", modulus, rest))

import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns named as operators name theirs."""
    def build(rows):
        full = [(i, t, "x", 1.0, "y", 7) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, node string, score double, places string, n_tokens int")

    return build


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, "Straße 東京 🎉 ﬁ\x00 \x1c end"),
    (7, "a b c d e f g h i j\n" * 40), (8, "long" * 30_000), (9, "a b c d e f g h i j\n" * 40), (None, "no key at all here"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def copies():
    """Texts with exact copies, near copies, shared passages, and periodic parts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n)).replace(" a", ".\nA")
    passage, texts = prose(40), {}
    for i in range(60):
        kind = i % 6
        if kind == 0 or i < 6:
            text = prose(rng.randint(20, 120))
        elif kind == 1:
            text = texts[rng.randrange(i)]
        elif kind == 2:
            words = texts[rng.randrange(i)].split(" ")
            for _ in range(rng.randint(1, 2)):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind == 3:
            text = f"{prose(rng.randint(5, 30))}\n{passage}\n{prose(10)}"
        elif kind == 4:
            text = prose(3) + f"{word()} " * rng.randint(30, 90)
        else:
            text = texts[rng.randrange(i)][20:] + passage[10:]
        texts[i] = text
    return texts

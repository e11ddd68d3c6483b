"""Token counts by heap-and-linked-list byte-pair merging.

Every word starts as a list of byte symbols. A heap holds the adjacent pairs that merge,
by rank and then place; the lowest is popped, the pair is joined in the linked list, and
the two new neighbours enter the heap. The count is the number of first symbols less the
number of merges; no ids are made.

Defined results: a null or empty text has 0 tokens. The vocabulary's special strings
inside a text count as one token each, as the library does by default.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from srcframe.llm.bpe_transducer import REMEMBERED, Words
from srcframe.llm.common import map_texts, per_worker
from srcframe.llm.words import WordTable

# Fixed value: the word pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in the vocabulary file."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    symbols, moved = [], 0
    for byte in range(256):
        symbols.append(chr(byte) if byte in plain else chr(256 + moved))
        moved += byte not in plain
    return symbols


def merges_of(word: list[int], merges: dict[int, tuple[int, int]]) -> int:
    """How many merges the word takes; ``merges`` has (rank, new symbol) by pair of symbols."""
    n = len(word)
    heap = []
    for i, pair in enumerate(zip(word, word[1:])):
        found = merges.get(pair[0] << 20 | pair[1])
        if found is not None:
            heap.append((found[0], i, *pair, found[1]))
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    done = 0
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if word[i] != left or j >= n or word[j] != right:
            continue  # one of the two has been merged meanwhile
        done += 1
        word[i], word[j] = new, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = merges.get(new << 20 | word[k])
            if found is not None:
                heapq.heappush(heap, (found[0], i, new, word[k], found[1]))
        h = before[i]
        if h >= 0:
            found = merges.get(word[h] << 20 | new)
            if found is not None:
                heapq.heappush(heap, (found[0], h, word[h], new, found[1]))
    return done


class Counter:
    """Counts of whole texts for one vocabulary file (JSON, byte-level)."""

    def __init__(self, path: str):
        import json

        import regex

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
        number = held["model"]["vocab"]
        self.merges = {number[a] << 20 | number[b]: (rank, number[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in held["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = Words(PATTERN)
        self.symbols = [number[s] for s in byte_symbols()]
        self.known = WordTable(self._tokens, REMEMBERED)

    def _tokens(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        return len(symbols) - merges_of(symbols, self.merges)

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special is not None:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            for words in self.words.of(part):
                total += sum(map(self.known.__getitem__, words))
        return total


def token_counts(df: DataFrame, path: str, limit: int = 512, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    def make():
        counter = per_worker(("counts", path), lambda: Counter(path))

        def work(texts):
            return [len(t.encode("utf-8", "surrogatepass")) for t in texts], [counter.count(t) for t in texts]

        return work

    counted = map_texts(df, text, make, "n_bytes bigint, n_tokens bigint", keep)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The merges define which two tokens may stand next to each other: ``a`` then ``b`` is
allowed when the merges turn the bytes of both into exactly these two. A text's encoding
is the one token sequence whose neighbours are all allowed. A non-deterministic transducer
guesses where tokens end; here it is made deterministic one state at a time, as texts
need it. A state holds every position from which a token may still be growing, with the
token before it. A step reads one byte, drops positions from which no token can grow, and
adds the new position. Tokens leave once all growing ones agree on them. As a token has a
bounded length, so has the lookahead.

Defined results: a null text is the empty text (no ids). Every other text, whitespace and
special-token strings included, is encoded as ordinary text. Decoding ids that are no
valid UTF-8 gives U+FFFD as Python's ``replace`` does; ids outside the vocabulary raise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from srcframe.llm.common import map_texts, per_worker
from srcframe.llm.words import WordTable

# Words, pairs of tokens, and states of the transducer that a task remembers; a full table starts anew.
REMEMBERED = 400_000
REMEMBERED_PAIRS = 100_000
REMEMBERED_STATES = 80_000
LOOK_BACK = 4096
CHUNK_CHARS = 1 << 20
CHUNK_IDS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tokens_of(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def token_table(path: str) -> list[bytes]:
    return tokens_of(read_ranks(path))


def merge_plainly(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges by their definition, but for the one that joins the last two parts."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Bytes to token ids; states and steps are made when first met.

    A state is the list of growing tokens, each as (node of the vocabulary's tree, token
    before it). Reading a byte tells which token ends there if the text stops there. Going
    back over these from the growing tokens gives the tokens that are settled.

    There may be a hundred thousand states and steps in each worker, so both are packed: a
    growing token is ``node << 24 | token before it + 1``, a state the bytes of these, and
    a step ``state << 24 | token that ends``.
    """

    NONE = (1 << 24) - 1

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = tokens_of(ranks)
        self.longest = max(map(len, self.token))
        self.child: dict[int, int] = {}  # node * 256 + byte: node
        self.end: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = node << 8 | byte
                node = self.child.get(step, 0)
                if not node:
                    self.child[step] = node = len(self.end)
                    self.end.append(-1)
            self.end[node] = rank
        self.inner = bytearray(len(self.end))  # whether a token may go on from a node
        for step in self.child:
            self.inner[step >> 8] = 1
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.neighbours: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        import struct

        first = struct.pack("<q", 0)
        self.numbers = {first: 0}
        self.states = [first]
        self.steps: dict[int, int] = {}  # state * 256 + byte: state and token that ends

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; none for a single byte."""
        if token not in self.halves:
            parts = merge_plainly(self.token[token], self.ranks)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _allowed(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens.

        Both are taken apart at the border, latest merge first. At each moment the two
        parts that touch must not merge before the next merge of either side takes one.
        """
        key = left << 32 | right
        known = self.neighbours.get(key)
        if known is not None:
            return known
        ranks, token, until, known = self.ranks, self.token, 1 << 40, True
        while True:
            crossing = ranks.get(token[left] + token[right])
            if crossing is not None and crossing < until:
                known = False
                break
            # equal pairs merge from the left, so a right side of the same rank is taken apart first
            of_left, of_right = self._split(left), self._split(right)
            if of_left and (not of_right or left > right):
                until, left = left, of_left[1]
            elif of_right:
                until, right = right + 1, of_right[0]
            else:
                break
        if len(self.neighbours) >= REMEMBERED_PAIRS:
            self.neighbours.clear()
        self.neighbours[key] = known
        return known

    def _step(self, step: int) -> int:
        import struct

        entries, ends, byte, state = [], -1, step & 255, self.states[step >> 8]
        for entry in struct.unpack(f"<{len(state) // 8}q", state):
            node, last = self.child.get(entry >> 24 << 8 | byte), (entry & self.NONE) - 1
            if node is None:
                continue
            token = self.end[node]
            if ends < 0 <= token and (last < 0 or self._allowed(last, token)):
                ends = token
            if self.inner[node]:
                entries.append(node << 24 | last + 1)
        if ends < 0:
            raise ValueError("the vocabulary has no token for a byte")
        entries.append(ends + 1)
        key = struct.pack(f"<{len(entries)}q", *entries)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        found = self.steps[step] = number << 24 | ends
        return found

    def _back(self, ends: list[int], at: int, start: int) -> list[int]:
        tokens = []
        while at > start:
            tokens.append(ends[at - 1])
            at -= len(self.token[tokens[-1]])
        tokens.reverse()
        return tokens

    def encode(self, word: bytes) -> list[int]:
        """Ids of a word; of a very long one the settled tokens leave every few thousand bytes."""
        if len(self.states) > REMEMBERED_STATES:
            self._forget()
        state, ends, steps, out, none = 0, [], self.steps, [], self.NONE
        for byte in word:
            step = state << 8 | byte
            found = steps.get(step)
            if found is None:
                found = self._step(step)
            state = found >> 24
            ends.append(found & none)
            if len(ends) >= LOOK_BACK:
                ends = self._emit(ends, out)
        return out + self._back(ends, len(ends), 0)

    def _emit(self, ends: list[int], out: list[int]) -> list[int]:
        """Emit what every continuation shares: no token can begin before the last ``longest`` bytes."""
        ways = {tuple(self._back(ends, at, 0)) for at in range(len(ends) - self.longest, len(ends) + 1)}
        settled = 0
        shortest = min(map(len, ways))
        while settled < shortest and len({w[settled] for w in ways}) == 1:
            settled += 1
        sure = next(iter(ways))[:settled]
        out.extend(sure)
        return ends[sum(len(self.token[t]) for t in sure):]


def chunks(text: str, cut) -> Iterator[str]:
    """Parts of a long text. Letter, blank, letter: a word always ends before that blank."""
    start = 0
    while len(text) - start > CHUNK_CHARS:
        found = cut.search(text, start + CHUNK_CHARS)
        if not found:
            break
        yield text[start:found.start() + 1]
        start = found.start() + 1
    yield text[start:]


class Words:
    """The matches of a word pattern, for long texts in parts.

    The pattern's classes are Unicode's; ``\\s`` is White_Space (Python's own has four
    controls more). Most texts hold only characters below U+0250, for which the same
    pattern with the classes written out runs in the faster standard library.
    """

    LATIN = 0x250

    def __init__(self, pattern: str):
        import re
        import unicodedata

        import regex

        inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
        self.all = regex.compile(inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cut = regex.compile(r"\p{L} \p{L}")
        chars = [chr(c) for c in range(self.LATIN)]
        blank = "".join(re.escape(c) for c in chars if regex.fullmatch(r"\p{White_Space}", c))
        letter = "".join(c for c in chars if unicodedata.category(c)[0] == "L")
        number = "".join(c for c in chars if unicodedata.category(c)[0] == "N")
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]")
        latin = latin.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
        latin = latin.replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]")
        self.latin = re.compile(latin)
        self.other = re.compile(f"[^\\0-{chr(self.LATIN - 1)}]")

    def of(self, text: str) -> Iterator[list[str]]:
        for part in chunks(text, self.cut):
            yield (self.all if self.other.search(part) else self.latin).findall(part)


class Encoder:
    """Whole texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.words = Words(pattern)
        self.known = WordTable(self._ids, REMEMBERED)

    def _ids(self, word: str) -> bytes:
        import struct

        ids = self.transducer.encode(word.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.known.__getitem__, words)) for words in self.words.of(text))


# Lead byte ranges with the number of bytes that follow, and the bounds of the second byte.
SEQUENCES = (
    (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
)


class Utf8State:
    """Tells after any bytes how many of the last ones begin an unfinished character.

    A state is (bytes still to come, bounds of the next one, bytes already read).
    """

    CLEAN = (0, 0x80, 0xBF, 0)

    @classmethod
    def step(cls, state, byte: int):
        wanted, low, high, have = state
        if wanted and low <= byte <= high:
            return (wanted - 1, 0x80, 0xBF, have + 1) if wanted > 1 else cls.CLEAN
        for first, last, more, low, high in SEQUENCES:
            if first <= byte <= last:
                return more, low, high, 1
        return cls.CLEAN

    @classmethod
    def unfinished(cls, data: bytes) -> int:
        # a character has four bytes at most, so earlier bytes cannot be open any more
        tail = data[-4:]
        while tail and 0x80 <= tail[0] <= 0xBF:
            tail = tail[1:]
        state = cls.CLEAN
        for byte in tail:
            state = cls.step(state, byte)
        return state[3] if state[0] else 0


def decode_stream(ids: Iterable[int], tokens: list[bytes]) -> Iterator[str]:
    """Text of an id stream, piece by piece; memory holds one piece and at most 3 bytes."""
    import itertools

    ids, rest = iter(ids), b""
    while some := list(itertools.islice(ids, CHUNK_IDS)):
        data = rest + b"".join(map(tokens.__getitem__, some))
        keep = len(data) - Utf8State.unfinished(data)
        rest = data[keep:]
        yield data[:keep].decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def round_trip(
    df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = True
) -> DataFrame:
    """``keep``, ``ids`` (binary, 4 bytes each), ``n_tokens`` and, on request, ``decoded``.

    One pass in place: a row never leaves its task. Both tables of a task (words and
    states) are bounded and only save time.
    """
    def make():
        import numpy as np

        encoder = per_worker(("bpe", path, pattern), lambda: Encoder(read_ranks(path), pattern))
        tokens = encoder.transducer.token

        def work(texts):
            ids = [encoder.packed(t) for t in texts]
            columns = [ids, [len(i) // 4 for i in ids]]
            if decode:
                columns.append(["".join(decode_stream(np.frombuffer(i, "<u4").tolist(), tokens)) for i in ids])
            return columns

        return work

    schema = "ids binary, n_tokens bigint" + (", decoded string" if decode else "")
    return map_texts(df, text, make, schema, keep)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded`` of a table that already holds packed ids; null gives ''."""
    import pyspark.sql.functions as F
    import pyspark.sql.types as T

    narrow = df.select(*keep, F.coalesce(F.col(ids), F.lit(b"")).alias("_ids"))
    out = T.StructType([*df.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens = per_worker(("tokens", path), lambda: token_table(path))
        for batch in batches:
            texts = ["".join(decode_stream(np.frombuffer(i, "<u4").tolist(), tokens)) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return narrow.mapInArrow(run, out)

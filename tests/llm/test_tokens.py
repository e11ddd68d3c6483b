import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from srcframe.llm import bpe_transducer as bpe
from srcframe.llm.token_counts import Counter, token_counts
from tests.llm.conftest import ODD

RANKS, COUNTS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ing", "  ", "\n", "'s", "'", "é", "中", "🎉", "\x1c", "\x85", "1", "٣", "-", "...", "<|endoftext|>", "ſ", "K", "​"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(2000)] + [t for _, t in ODD if t]


def test_ids_are_the_library_s(library, texts):
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), P.PATTERN)
    for text in texts:
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == library.encode_ordinary(text)


def test_long_words_leave_the_transducer_early(library):
    transducer = bpe.Transducer(bpe.read_ranks(RANKS))
    rng = random.Random(6)
    for letters in ("a", "ab", "aeinst"):
        word = "".join(rng.choices(letters, k=3 * bpe.LOOK_BACK))
        assert transducer.encode(word.encode()) == library.encode_ordinary(word)


def test_tables_of_a_worker_are_packed(library):
    """Words that are all new fill the tables; what a word, its states and steps take is bounded."""
    ranks, rng = bpe.read_ranks(RANKS), random.Random(7)
    words = ["".join(rng.choices("aeioulnrstéèç", k=rng.randint(4, 12))) for _ in range(12_000)]
    encoder = bpe.Encoder(ranks, P.PATTERN)
    tracemalloc.start()
    try:
        for word in words:
            assert np.frombuffer(encoder.known[word], "<u4").tolist() == library.encode_ordinary(word)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    transducer = encoder.transducer
    assert len(transducer.states) > 2000 and len(transducer.neighbours) <= bpe.REMEMBERED_PAIRS
    tables = len(words) * 250 + len(transducer.states) * 250 + len(transducer.steps) * 160 + len(transducer.neighbours) * 130
    assert held < tables


def test_pairs_start_anew_when_the_table_is_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 50)
    transducer, rng = bpe.Transducer(bpe.read_ranks(RANKS)), random.Random(8)
    for _ in range(300):
        word = "".join(rng.choices("aeinst", k=9))
        assert transducer.encode(word.encode()) == library.encode_ordinary(word)
        assert len(transducer.neighbours) <= 50


def test_parts_of_a_long_text_give_the_same_words():
    words, text = bpe.Words(P.PATTERN), "one two  three\n\nfour's 5 " * 90_000
    assert sum(words.of(text), []) == words.all.findall(text)


def test_decoding_holds_back_unfinished_characters():
    text = "aé中🎉" * 3
    tokens = [bytes([b]) for b in range(256)]
    assert "".join(bpe.decode_stream(text.encode(), tokens)) == text
    for cut in range(len(text.encode())):
        data = text.encode()[:cut]
        open_bytes = bpe.Utf8State.unfinished(data)
        data[:len(data) - open_bytes].decode()  # never raises
        assert open_bytes < 4
    bad = b"\xff\xc3(\xe2\x82a\xf0\x9f"
    assert "".join(bpe.decode_stream(bad, tokens)) == bad.decode("utf-8", "replace")


def test_round_trip_of_odd_rows(odd, empty, library):
    rows = bpe.round_trip(odd, RANKS, P.PATTERN).collect()
    want = {i: t or "" for i, t in ODD}
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.decoded == want[r.doc_id] and r.n_tokens == len(r.ids) // 4 == len(library.encode_ordinary(want[r.doc_id]))
    ids = bpe.round_trip(odd, RANKS, P.PATTERN, decode=False)
    assert {r.doc_id: r.decoded for r in bpe.decode_ids(ids, RANKS).collect()} == want
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_digest_query_hashes_little_endian_ids(odd, library):
    from srcframe.llm.queries import bpe_digest

    row = bpe_digest(odd.where("doc_id = 6")).first()
    text = dict(ODD)[6]
    ids = b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text))
    assert row.ids_sha256 == hashlib.sha256(ids).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_counts_are_the_library_s(texts):
    counter, library = Counter(COUNTS), Tokenizer.from_file(COUNTS)
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert counter.count(text) == len(found.ids)


def test_counts_of_odd_rows(odd, empty):
    rows = {r.doc_id: r for r in token_counts(odd, COUNTS, limit=100).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and not rows[1].over_limit
    assert rows[6].n_bytes == len(dict(ODD)[6].encode()) and rows[8].over_limit
    assert token_counts(empty, COUNTS).count() == 0

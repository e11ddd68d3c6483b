import random

import numpy as np
import pytest

from srcframe.llm import jaccard_join, line_dedup, suffix_dedup
from tests.llm import brute
from tests.llm.conftest import ODD


def lines_result(df, **kw):
    return {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup(df, **kw).collect()}


def lines_wanted(texts, least=8):
    gone = brute.deleted_lines(texts, least)
    return {k: (len(gone[k]), brute.without_lines(texts[k], gone[k])) for k in texts}


@pytest.mark.parametrize("least", [3, 8])
def test_line_dedup_on_random_lines(docs_of, least):
    rng = random.Random(least)
    lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 5))) for _ in range(12)] + ["", "  "]
    texts = {}
    for i in range(60):
        if i % 4 == 3:
            held = texts[rng.randrange(i)].split("\n")
            cut = rng.randrange(len(held))
            texts[i] = "\n".join(held[cut:] + held[:cut // 2] + [f"only {i}"])
        else:
            texts[i] = "\n".join(rng.choices(lines, k=rng.randint(1, 9)))
    assert lines_result(docs_of(list(texts.items())), least=least) == lines_wanted(texts, least)


def test_line_dedup_finds_every_run(docs_of):
    """Runs whose lines and pairs of lines all stand earlier in other contexts."""
    a, b, c, x, y = (f"{k}1 {k}2 {k}3" for k in "abcxy")
    texts = {1: f"{a}\n{b}\n{x}", 2: f"{y}\n{b}\n{c}", 10: f"{a}\n{b}\n{c}", 20: f"{a}\n{b}\n{c}"}
    got = lines_result(docs_of(list(texts.items())))
    assert got == lines_wanted(texts) and got[20] == (3, "")
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 5))) for _ in range(6)]
    texts = {i: "\n".join(rng.choices(lines, k=rng.randint(1, 9))) for i in range(200)}
    for least in (4, 8, 11):
        assert lines_result(docs_of(list(texts.items())), least=least) == lines_wanted(texts, least)


def test_line_dedup_on_copies(docs_of, copies):
    assert lines_result(docs_of(list(copies.items()))) == lines_wanted(copies)


def test_line_dedup_of_odd_rows(odd, empty):
    texts = {k: t for k, t in ODD if k is not None}
    got = lines_result(odd)
    assert got.pop(None) == (0, dict(ODD)[None])
    assert got == lines_wanted(texts)
    assert line_dedup.dedup(odd).columns == [*odd.columns, "n_lines", "n_removed"]
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_of_repeated_rows(docs_of):
    line = "one two three four five six seven eight nine"
    got = line_dedup.dedup(docs_of([(1, line), (1, line), (2, line)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 1)]


def test_line_dedup_is_native(docs_of):
    seqs = line_dedup.sequences(docs_of([(1, "a b")]), "doc_id", "text")
    prints = line_dedup.fingerprints(seqs, 8)
    pairs = line_dedup.position_pairs(prints)
    for df in (seqs, prints, pairs, line_dedup.extended(pairs, seqs, 8), line_dedup.dedup(docs_of([(1, "a b")]))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_are_window_minima(docs_of):
    rng = random.Random(8)
    text = "\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 5))) for _ in range(40))
    seqs = line_dedup.sequences(docs_of([(1, text)]), "doc_id", "text")
    hashes, words = seqs.select("hashes", "words").first()
    rows = line_dedup.fingerprints(seqs, 8).collect()
    for r in rows:
        n = next((n for n in range(1, 9) if sum(words[r.at:r.at + n]) >= 8), 9)
        window = hashes[r.at:r.at + n]
        if n < 9 and hashes[r.print] == min(window):  # a window ahead; those back end elsewhere
            assert r.print == r.at + window.index(min(window))
    # a fingerprint serves several windows, and every window of eight words has one
    assert len({r.print for r in rows}) < len({(r.at, r.group) for r in rows})
    starts = {r.at for r in rows}
    assert all(i in starts for i in range(40) if sum(words[i:]) >= 8)


def test_matches_are_extended_both_ways(docs_of):
    lines = [f"a{i} b{i} c{i}" for i in range(9)]
    texts = {1: "\n".join(["x y", *lines, "z"]), 2: "\n".join(["other", *lines, "more"])}
    seqs = line_dedup.sequences(docs_of(list(texts.items())), "doc_id", "text")
    pairs = line_dedup.position_pairs(line_dedup.fingerprints(seqs, 8))
    assert {(r.doc.id, r.first.id, r.print - r.first_print) for r in pairs.collect()} == {(2, 1, 0)}
    runs = line_dedup.extended(pairs, seqs, 8).collect()
    assert {i for r in runs for i in range(r["from"], r["to"])} == set(range(1, 10))
    # one pair reaches further than a window of three lines
    assert max(r["to"] - r["from"] for r in runs) > 3


def test_line_dedup_keeps_columns_with_clashing_names(spark):
    line = "one two three four five six seven eight nine"
    shape = "doc_id bigint, text string, n_lines int, n_removed int, doc string, `__doc` string, `a.b` int, row string"
    df = spark.createDataFrame([(1, line, 5, 6, "d", "e", 7, "r"), (2, line + "\nx", 5, 6, "d", "e", 7, "r")], shape)
    got = line_dedup.dedup(df)
    assert got.columns == [*df.columns, "_n_lines", "_n_removed"]
    assert sorted(map(tuple, got.collect())) == [
        (1, line, 5, 6, "d", "e", 7, "r", 1, 0), (2, "x", 5, 6, "d", "e", 7, "r", 2, 1)]


def near_result(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(df, jaccard_join.Settings(**kw)).collect()}


@pytest.mark.parametrize("settings", [{}, {"block": 2, "frequent": 5, "bucket": 50}, {"frequent": 0}])
def test_jaccard_classes(docs_of, copies, settings):
    assert near_result(docs_of(list(copies.items())).repartition(3), **settings) == brute.near_classes(copies)


def test_jaccard_links_at_the_threshold(docs_of):
    words = [f"w{i}" for i in range(40)]
    base = " ".join(words)  # 36 shingles; one word less at the end: 35
    texts = {10: base, 11: " ".join(words[:-4]), 12: " ".join(words[:32]), 13: " ".join(words[:33]).upper(), 14: "w0 w1 w2", 15: "W0\tw1\nw2 "}
    got = near_result(docs_of(list(texts.items())))
    assert got == brute.near_classes(texts) and got[15][1] == 14


def test_jaccard_star_of_copies(docs_of):
    """Copies that each link with their origin alone, which has the largest key."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = {100: " ".join(base)}
    for i in range(40):
        held = list(base)
        held[rng.randrange(60)] = f"x{i}"
        texts[i] = " ".join(held)
    assert near_result(docs_of(list(texts.items())), block=7) == brute.near_classes(texts)


def test_jaccard_of_odd_rows(odd, empty):
    got = near_result(odd)
    got.pop(None)
    assert got == brute.near_classes({k: t for k, t in ODD if k is not None})
    assert near_result(empty) == {}
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, None}


def test_jaccard_with_frequent_ngrams_in_several_buckets(docs_of, copies):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = {1000 + i: f"{passage} " + " ".join(f"q{rng.randrange(30)}" for _ in range(rng.randint(0, 6))) for i in range(60)}
    texts |= copies
    assert near_result(docs_of(list(texts.items())).repartition(5), bucket=10) == brute.near_classes(texts)


def test_one_of_each_tells_rows_apart_by_text(docs_of):
    prose = " ".join(f"w{i}" for i in range(60))
    unique = " ".join(f"u{i}" for i in range(60))
    rows = [(3, prose), (7, prose + " end"), (7, unique), (7, unique), (9, "a b"), (9, "a b"), (10, "A  b"), (None, prose), (None, prose), (11, ""), (11, None)]
    kept = jaccard_join.one_of_each(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(3, prose), (7, unique), (9, "a b"), (None, prose), (None, prose), (11, ""), (11, None)], key=str)


def test_tree_finds_every_component():
    rng = random.Random(4)
    for _ in range(40):
        pool = [np.array(sorted(rng.sample(range(40), rng.randint(1, 30))), np.uint64) for _ in range(6)]
        sets = [np.unique(np.r_[s, np.array(rng.sample(range(40), rng.randint(0, 2)), np.uint64)]) for s in pool for _ in range(5)]
        tree = jaccard_join.Tree(80)
        for s in sets:
            tree.add(s)
        label = brute_components(sets)
        assert all((tree.find(a) == tree.find(b)) == (label[a] == label[b]) for a in range(len(sets)) for b in range(len(sets)))


def brute_components(sets):
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if brute.linked(set(sets[a].tolist()), set(sets[b].tolist())):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return label


def suffix_result(df, **kw):
    import hashlib

    rows = suffix_dedup.dedup(df, suffix_dedup.Settings(**kw)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}


@pytest.mark.parametrize("length, bucket", [(100, 400_000), (100, 1), (101, 20), (131, 400_000)])
def test_suffix_dedup_on_copies(docs_of, copies, length, bucket):
    assert suffix_result(docs_of(list(copies.items())).repartition(3), length=length, bucket=bucket) == brute.repeats(copies, length)


def test_suffix_dedup_of_odd_rows(docs_of, odd, empty):
    texts = {k: t for k, t in ODD if k is not None}
    got = suffix_result(odd)
    assert got.pop(None)[1:3] == (0, 0)
    assert got == brute.repeats(texts)
    assert suffix_result(empty) == {}
    rows = [(r.doc_id, r.n_removed) for r in suffix_dedup.dedup(docs_of([(1, "ab" * 60 + "c"), (1, "ab" * 60 + "c")])).collect()]
    assert rows == [(1, 118)] * 2  # the two rows are one document, repeated in itself


def test_suffix_dedup_of_repeated_rows_beside_another(docs_of):
    """A repeated row is one document, also where its runs meet those of others."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shared = word(180)
    texts = {1: word(150) + shared + word(150), 2: word(90) + shared[20:170] + word(90)}
    rows = [(1, texts[1]), (1, texts[1]), (2, texts[2])]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup(docs_of(rows).repartition(3)).collect())
    want = {key: sum(gone) for key, (_, gone) in brute.removed_bytes(texts).items()}
    assert want == {1: 0, 2: 150} and got == [(1, 0), (1, 0), (2, 150)]


@pytest.fixture(scope="module")
def passages():
    """A passage and a shorter string that stand in most texts, in other surroundings each time."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefghé ", k=n))
    passage, short = word(150), word(50)
    texts = {}
    for i in range(80):
        cut = rng.randint(0, 40)
        texts[i] = word(rng.randint(0, 90)) + (passage[cut:] if i % 5 else short) + word(rng.randint(0, 60)) + (short if i % 3 else passage) + word(20)
    texts[90] = "ab" * 300 + passage * 3
    return texts


@pytest.mark.parametrize("hot, bucket", [(0, 400_000), (0, 5), (2_000, 400_000), (1 << 20, 400_000)])
def test_suffix_dedup_of_hot_strings(docs_of, copies, passages, hot, bucket):
    for texts in (passages, copies):
        assert suffix_result(docs_of(list(texts.items())).repartition(3), hot=hot, bucket=bucket, sorted_bytes=500) == brute.repeats(texts)


@pytest.mark.parametrize("waiting", [0, 5, 200_000])
def test_suffix_dedup_of_long_texts_in_parts(docs_of, copies, passages, monkeypatch, waiting):
    """Texts above the bound of a piece are worked on in parts that overlap."""
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 130)
    monkeypatch.setattr(suffix_dedup, "WAITING", waiting)
    texts = {**{1000 + k: t for k, t in copies.items()}, **passages}
    assert suffix_result(docs_of(list(texts.items())).repartition(3), hot=3_000) == brute.repeats(texts)


def test_parts_of_a_run_share_their_bytes():
    rng = random.Random(1)
    data = bytes(rng.choices(b"abcd", k=400))
    run = np.array([(1, 0, 120, 69, 68, 7)], suffix_dedup.WANTED)[0]
    for width in (69, 9, 1):
        starts = []
        for key, content, start, n in suffix_dedup.parts_of(data, run, width, 100):
            starts += range(start, start + n)
            # the same part in other surroundings has the same key
            other = bytes(10) + data[start:start + n + 99] + bytes(10)
            moved = np.array([(2, 0, 10, n, 188 - start, 7)], suffix_dedup.WANTED)[0]
            assert (key, content, 10, n) in list(suffix_dedup.parts_of(other, moved, width, 100))
        assert sorted(starts) == list(range(120, 189))


def test_cover_reaches_every_pair():
    shifts = suffix_dedup.common_shifts()
    assert shifts.min() == 0 and shifts.max() < suffix_dedup.PERIOD


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
def test_suffixes_of_one_bucket(alphabet):
    rng = random.Random(len(alphabet))
    text = "".join(rng.choices(alphabet, k=700)).encode()
    text = text + text[100:350] + b"z" + text[200:330]
    starts = np.arange(len(text) - 99)
    again = suffix_dedup.repeated_suffixes(np.frombuffer(text, np.uint8), starts, (starts,), 100)
    seen, want = set(), []
    for s in starts:
        want.append(text[s:s + 100] in seen)
        seen.add(text[s:s + 100])
    assert again.tolist() == want

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from srcframe.llm import decontaminate as dec, queries

ITEM = "A farmer sells 12 apples to Alice for 30 cents each and then Alice buys 4 kg of ripe pears from the same farmer"
SWAPPED = ITEM.replace("12", "57").replace("Alice", "Robert").replace("4 kg", "9 lb").replace("30", "1,250.5")
BROKEN = ITEM.replace("to Alice", "to Robert").replace("then Alice", "then Maria")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(7, ITEM, 1), (8, "too short", 1), (9, None, 1)], "item_id bigint, text string, doc_id int")


def found(docs, benchmark, **settings):
    return {(r.doc_id, r.item_id): (r.n_matched, r.n_windows) for r in dec.leaks(docs, benchmark, dec.Settings(**settings)).collect()}


def test_reparameterised_items_are_found(docs_of, benchmark):
    around = "some other words before it. {} And more words after that, as usual."
    docs = docs_of([
        (1, around.format(ITEM)), (2, around.format(SWAPPED)), (3, around.format(BROKEN)), (4, around.format("nothing")),
        (5, around.format(ITEM[:40])), (6, around.format(f"{SWAPPED} {ITEM}")), (None, ITEM)])
    hits = found(docs, benchmark)
    assert {d for d, _ in hits} == {1, 2, 6} and {i for _, i in hits} == {7}
    assert hits[1, 7] == hits[6, 7]


def test_short_items_and_items_of_few_literals_are_found(spark, docs_of):
    items = [(1, "Who wrote Hamlet?"), (2, "What is 12 plus 30"), (3, "Add 3 km 4 km 5 km 6 km 7 km then 8 km gives how many"), (4, "7 8 9")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_of([
        (1, "Quiz: who wrote Hamlet? Nobody."), (2, "So what is 12 plus 30 now"), (3, "what is 5 plus 9"), (4, "who wrote what"),
        (5, "Add 13 m 14 m 15 m 16 m 17 m then 18 m gives how many"), (6, "1 km 2 km 3 km 4 km 5 km 9 km 10 km"), (7, "at 7 8 9 and 10"), (8, "1 2 3")])
    assert set(found(docs, bench)) == {(1, 1), (2, 2), (5, 3), (7, 4)}


def test_copies_in_other_case_or_wrapping_are_found(spark, docs_of):
    names = "We saw Alice and Robert with Maria near Paris before Peter told Susan about Berlin and asked James for Helen again"
    twice = "Each box holds 2 red apples and every box is kept for 2 full days before all of it goes away"
    bench = spark.createDataFrame([(1, names), (2, twice)], "item_id bigint, text string")
    docs = docs_of([
        (1, names), (2, names.lower()), (3, names.upper()), (4, names.replace(" ", " \r\n")), (5, names.title()),
        (6, twice.replace("2 red", "5 red").replace("2 full", "9 full")), (7, names.replace("Alice", "Tom").lower().replace("tom", "tim")),
        (8, "\u00a0 ".join(twice.split(" ")))])
    assert set(found(docs, bench)) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2), (7, 1), (8, 2)}


def test_template_words_and_raw_words_stand_together(spark):
    texts = ["On 3 May John ate 4kg, x9y (1,000.5) of Old Bread.", "ÉCOLE ab  7 km", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(dec.template_words(df.t).alias("a"), dec.raw_words(df.t).alias("b")).collect()
    assert all(len(r.a) == len(r.b) for r in rows)
    n, w, u = dec.NUMBER, dec.NAME, dec.UNIT
    assert rows[0].a == ["on", n, w, w, "ate", n, u, "x", n, "y", n, "of", w, w]
    assert rows[1].a[-2:] == [n, u] and rows[2].a == rows[3].a == []


def template(text, names=True):
    """Words and slots by the definition, for plain words, numbers and Capitalised names."""
    out, last = [], ""
    for word in text.split():
        bare = word.strip(".,?")
        if bare[0].isdigit():
            out.append(dec.NUMBER)
        elif names and bare[0].isupper() and last and (last[-1].islower() or last[-1].isdigit() or last[-1] in ",;:"):
            out.append(dec.NAME)
        elif out and out[-1] == dec.NUMBER and last[-1].isdigit() and bare.lower() in dec.UNITS:
            out.append(dec.UNIT)
        else:
            out.append(bare.lower())
        last = word
    return out


def plain_leaks(docs, items, size=8, literals=4, share=0.5):
    """Every window of every document against every window of every item."""
    found = {}
    for d, text in docs.items():
        words, folded, raw = template(text), template(text, False), [w.strip(".,?").lower() for w in text.split()]
        for i, item in items.items():
            i_words, i_folded, i_raw = template(item), template(item, False), [w.strip(".,?").lower() for w in item.split()]
            n = min(size, len(i_words))
            places = range(len(i_words) - n + 1)
            strong = {a: sum(w not in dec.SLOTS for w in i_words[a:a + n]) >= literals for a in places}
            weak = sum(strong.values()) < share * len(places)
            diagonals, usable = {}, [a for a in places if strong[a] or weak]
            for a in usable:
                for b in range(len(words) - n + 1):
                    mine, its = words[b:b + n], i_words[a:a + n]
                    same = mine == its or dec.NAME in its and i_folded[a:a + n] in (folded[b:b + n], mine) or dec.NAME in mine and folded[b:b + n] == its
                    if same:
                        diagonals.setdefault(b - a, []).append((a, b))
            covered = set()
            for met in diagonals.values():
                pairs, exchanged, agreed, exact, literal = set(), {}, {}, {}, set()
                for a, b in met:
                    slots = [(k, i_raw[a + j], raw[b + j]) for j, k in enumerate(i_words[a:a + n]) if k in dec.SLOTS]
                    names = {(v, g) for k, v, g in slots if k == dec.NAME}
                    pairs |= names
                    exchanged[a] = any(v != g for v, g in names)
                    others = {(k, v, g) for k, v, g in slots if k != dec.NAME}
                    agreed[a] = len(others) == len({(k, v) for k, v, _ in others})
                    exact[a] = not slots or raw[b:b + n] == i_raw[a:a + n]
                    literal |= {a + j for j, k in enumerate(i_words[a:a + n]) if k not in dec.SLOTS}
                consistent = len(pairs) == len({v for v, _ in pairs})
                enough = any(strong[a] for a, _ in met) or len(literal) >= literals
                covered |= {a for a, _ in met if exact[a] or enough and agreed[a] and (consistent or not exchanged[a])}
            if covered and len(covered) / len(usable) >= share:
                found[d, i] = len(covered), len(usable)
    return found


def test_against_brute_force_with_slots(spark, docs_of):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    names, units = ["Anna", "Ben", "Cora", "Dan"], ["kg", "km", "days"]

    def sentence():
        out = [rng.choice(words) for _ in range(rng.randint(6, 18))]
        for _ in range(rng.randint(0, 4)):
            out.insert(rng.randint(1, len(out)), rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            out.insert(rng.randint(1, len(out)), rng.choice([str(rng.randint(1, 9)), f"{rng.randint(1, 9)} {rng.choice(units)}"]))
        return out

    items = {i: " ".join(sentence()) for i in range(14)}
    docs = {}
    for d in range(150):
        item = items[rng.randrange(14)].split()
        swap = {w: rng.choice(names + ["Eve"]) for w in names} | {str(n): str(rng.randint(1, 99)) for n in range(10)} | {u: rng.choice(units) for u in units}
        kind = rng.randrange(4)
        if kind == 1:  # other values throughout
            item = [swap.get(w, w) for w in item]
        elif kind == 2:  # other values at random, so some stand for two
            item = [rng.choice([swap.get(w, w), w]) if rng.random() < 0.5 else w for w in item]
        elif kind == 3:  # another slot value each time
            item = [str(rng.randint(1, 99)) if w.isdigit() else rng.choice(names) if w in names else w for w in item]
        docs[d] = " ".join(sentence() + item[rng.randint(0, 4):] + sentence())
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    want = plain_leaks(docs, items)
    got = found(docs_of(list(docs.items())), bench)
    assert got == want and 40 < len({d for d, _ in got}) < 140


def test_a_value_for_two_within_a_window_does_not_count(spark, docs_of):
    item = "first take 2 big cups and then 2 more cups of tea"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = docs_of([(1, item), (2, item.replace("2", "5")), (3, item.replace("2 big", "5 big").replace("2 more", "9 more"))])
    assert set(found(docs, bench)) == {(1, 1), (2, 1)}


def test_against_brute_force(spark, docs_of):
    rng = random.Random(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    items = {i: [rng.choice(words) for _ in range(rng.randint(8, 20))] for i in range(12)}
    docs = {}
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        item = items[rng.randrange(12)]
        cut = rng.randint(0, len(item))
        docs[d] = text + item[:cut] + text[:5]
    size, want = 8, {}
    for d, text in docs.items():
        held = {tuple(text[i:i + size]) for i in range(len(text) - size + 1)}
        for i, item in items.items():
            windows = [tuple(item[k:k + size]) for k in range(len(item) - size + 1)]
            hit = sum(w in held for w in windows)
            if hit and hit / len(windows) >= 0.5:
                want[d, i] = hit, len(windows)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    assert found(docs_of([(d, " ".join(w)) for d, w in docs.items()]), bench) == want


def test_odd_rows(odd, empty, benchmark):
    assert found(odd, benchmark) == found(empty, benchmark) == found(odd, benchmark.limit(0)) == {}
    assert dec.clean(odd, benchmark).count() == odd.count()
    assert dec.clean(odd, benchmark).columns == odd.columns


def test_main_path_is_native(docs_of, benchmark):
    plan = dec.leaks(docs_of([(1, ITEM)]), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_row_groups_are_not_held_outside_the_heap(spark, tmp_path):
    def held():
        jvm = spark._jvm
        pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
        return next(p.getMemoryUsed() for p in pools if p.getName() == "direct")

    rng = random.Random(5)
    texts = ["".join(rng.choices("!#$%&()*+-/:;<=>?@", k=12_000)) for _ in range(2_500)] + [ITEM]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    pq.write_table(docs, tmp_path / "documents.parquet", compression="none", use_dictionary=False)
    pq.write_table(pa.table({"item_id": pa.array([7], pa.int64()), "text": [ITEM]}), tmp_path / "benchmark.parquet")
    assert pq.ParquetFile(tmp_path / "documents.parquet").num_row_groups == 1
    before = held()
    got = queries.QUERIES["op1_decontaminate"](spark, str(tmp_path)).collect()
    # a row group of 30 MB
    assert held() - before < 8 << 20
    assert [(r.doc_id, r.item_id, r.coverage) for r in got] == [(2_500, 7, 1.0)]

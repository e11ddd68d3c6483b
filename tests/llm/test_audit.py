"""The filter audit against a run of every order over every document."""

import itertools
import random
import re

from pyspark.sql import functions as F

from srcframe.llm import filter_audit as A

SHAPE = "doc_id bigint, text string, source string, mask string, part int, n int"


def fails_of(rows):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    out = []
    for doc, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": doc is not None and least[t] < doc})
    return out


def plain_audit(rows, good, toxic):
    fails, out = fails_of(rows), {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, fails) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, letter in enumerate(order, 1):
                removed = [i for i in left if mine[i][1][letter]]
                gone = set(range(len(mine))) - set(left)
                left = [i for i in left if i not in set(removed)]
                total[letter] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(mine[i][1][letter] for i in gone),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in mine),
                    sum(mine[i][0] in good for i in removed), sum(mine[i][0] in toxic for i in removed), letter]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return out


def labels_of(spark, good, toxic):
    rows = [(d, 1 if d in good else 0, 1 if d in toxic else None) for d in sorted(good | toxic)] + [(None, 1, 1)]
    return spark.createDataFrame(rows + rows[:2], "doc_id bigint, quality int, toxic int")


def result(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in (*A.COUNTS, "shapley")] for r in df.collect()}


def docs_from(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SHAPE)


def test_equal_to_running_every_order(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["ABC", "D#", "é", "X" * 30]
    texts = [" ".join(rng.choice(words[:rng.choice([3, 40, 64])]) for _ in range(rng.choice([0, 10, 49, 50, 80]))) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(200)]
    rows += [(3, texts[0], "a"), (3, texts[0], "a"), (None, texts[0], "b"), (None, texts[1], "a"), (500, None, "c"), (501, "", "c"), (-1, texts[2], "z")]
    good, toxic = set(range(0, 200, 3)), set(range(0, 200, 7)) | {500}
    got = result(A.audit(docs_from(spark, rows), labels_of(spark, good, toxic)))
    assert got == plain_audit(rows, good, toxic) and len(got) == 600 * 5


def test_bounds_of_the_conditions(spark):
    texts = ["a " * 50, " ".join(f"w{i}" for i in range(65)) + " w0" * 35, "A" * 5 + "b" * 95, "A" * 6 + "b" * 94, "x|", "\x0b\x1cx", "x y"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    held = {r.doc: r.mask for r in A.facts(docs_from(spark, rows)).collect()}
    assert held == {i: sum(f[c] << n for n, c in enumerate("ABCD")) for i, f in enumerate(fails_of(rows))}


def test_empty_table_and_odd_rows(spark):
    labels = labels_of(spark, {1}, {2})
    assert A.audit(docs_from(spark, []), labels).count() == 0
    rows = [(1, None, None), (2, "", ""), (3, "long " * 200_000, None), (3, "long " * 200_000, None)]
    assert result(A.audit(docs_from(spark, rows), labels)) == plain_audit(rows, {1}, {2})
    assert result(A.audit(docs_from(spark, rows), labels.limit(0))) == plain_audit(rows, set(), set())


def test_fields_do_not_run_over():
    for rows in (1, 255, 256, 70_000, 10 ** 13):
        width = A.field_width(rows)
        packed = A.packed_masks(width)
        total = rows * packed[31]
        counts = A.unpacked(total, width)
        assert (counts == rows * A.outcomes()[31].astype(int)).all()


def test_texts_are_not_shuffled(spark):
    docs = docs_from(spark, [(1, "a", "b")])
    plan = A.facts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    held = A.facts(docs)
    assert [f.name for f in held.schema] == ["doc", "part", "mask", "hash"]
    assert held.select(F.octet_length("hash")).first()[0] == 32

import pytest

from srcframe.llm import quality, toxicity
from srcframe.llm.labelled import held_out

SMALL = quality.Settings(buckets=1 << 12, epochs=6, per_class=200)


@pytest.fixture(scope="module")
def labelled(spark):
    good = [(i, f"the quiet river runs past house {i} and on") for i in range(100)]
    bad = [(i, f"BUY!! NOW!! {i} CHEAP!!") for i in range(100, 200)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 100), None if i % 7 == 0 else int(i >= 100)) for i in range(200)] + [(1, 1, 0), (None, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_held_out_documents_are_told_apart(labelled):
    rows = quality.classify(*labelled, SMALL).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and all(r.predicted == (r.doc_id < 100) for r in held)


def test_held_out_labels_are_not_learned_from(spark, labelled):
    docs, labels = labelled
    wrong = labels.selectExpr("doc_id", "case when crc32(cast(string(doc_id) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    scores = lambda l: {r.doc_id: r.score for r in quality.classify(docs, l, SMALL).collect()}
    assert scores(labels) == scores(wrong)


def test_repeated_words_count():
    ids, counts = quality.features("go go go on", SMALL)
    again = quality.buckets_of(quality.REPEATED, SMALL)[0]
    assert counts[ids == again].tolist() == [2.0]


def test_quality_of_odd_rows(odd, empty, labelled):
    rows = quality.classify(odd, labelled[1], SMALL).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows} == {0.5}  # no labelled text
    assert quality.classify(empty, labelled[1], SMALL).count() == 0


def toxic_sample(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = f"some words about thing{i} and a glorp" if not bad else f"you are such a glorp and fool{i % 5} glorping all day"
        if i % 3 == 1:
            text = f"the kind glorp of place {i} stands far away from here today"
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_lexicon_is_learned(spark):
    docs, labels = toxic_sample(spark)
    model = toxicity.fit(docs, labels, held_out("doc_id", 3, 1))
    assert any(entry.startswith(" foo") for entry in model.lexicon) and len(model.lexicon) > 3
    rows = toxicity.score(docs, model).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in rows)


def test_folding_and_exceptions():
    folder = toxicity.Folder()
    assert toxicity.fold("Ｆ00l! fооl  ÉCOLE", folder) == " fool fool école "
    matcher = toxicity.Matcher({" glorp": 2.0, " glor": 1.0, " fool ": 3.0}, [" kind glorp "])
    assert matcher.measure("Gl0rping FOOL fools") == (5.0, 3)
    assert matcher.measure("a kind glorp and a glorp") == (2.0, 6)
    assert matcher.measure("") == (0.0, 0)


def test_toxicity_of_odd_rows(spark, odd, empty):
    docs, labels = toxic_sample(spark)
    rows = toxicity.classify(odd, labels.limit(0)).collect()
    assert len(rows) == odd.count() and all(r.score < 0.01 and r.predicted == 0 for r in rows)
    model = toxicity.fit(docs, labels, held_out("doc_id", 3, 1))
    assert toxicity.score(odd, model).where("predicted = 1 and doc_id is not null").count() == 0
    assert toxicity.score(empty, model).count() == 0


def held_out_counts(spark, scored, name, modulus, rest):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{GIVEN}/labels.parquet").groupBy("doc_id").agg(F.max(name).alias("label"))
    rows = scored.join(labels, "doc_id").where(held_out("doc_id", modulus, rest) & F.col("label").isNotNull())
    return {(r["label"], r["predicted"]): r["count"] for r in rows.groupBy("label", "predicted").count().collect()}


GIVEN = "/root/testdata/sf0.1"


def test_recall_on_held_out_labels(spark):
    """On the given tables, with the parameters of the queries."""
    docs, labels = (spark.read.parquet(f"{GIVEN}/{n}.parquet") for n in ("documents", "labels"))
    found = held_out_counts(spark, quality.classify(docs, labels), "quality", 5, 0)
    assert found[0, 0] >= 0.95 * (found[0, 0] + found.get((0, 1), 0))  # bad ones rejected
    assert found[1, 1] >= 0.99 * (found[1, 1] + found.get((1, 0), 0))  # good ones kept
    found = held_out_counts(spark, toxicity.classify(docs, labels), "toxic", 3, 1)
    assert found[1, 1] >= 0.9 * (found[1, 1] + found.get((1, 0), 0))
    assert found[0, 0] >= 0.99 * (found[0, 0] + found.get((0, 1), 0))

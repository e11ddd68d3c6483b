"""The pipeline against plain versions of its stages, on the smallest given tables."""

import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from srcframe.llm import common, quality
from srcframe.llm.bpe_transducer import read_ranks
from srcframe.llm.common import load
from srcframe.llm.decontaminate import leaks
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs, labels = load(spark, FOLDER, "documents"), load(spark, FOLDER, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(i in good for i, q in known.items() if q == 1)
    assert sum(i in good for i, q in known.items() if q == 0) <= 3
    kept = {i: t for i, t in texts.items() if i in good}
    gone = brute.deleted_lines(kept)
    full = {i: sum(bool(line) for line in brute.lines_of(t)) for i, t in kept.items()}
    kept = {i: brute.without_lines(t, gone[i]) for i, t in kept.items() if not gone[i] or len(gone[i]) < full[i]}
    kept = {i: kept[i] for i, (_, c) in brute.near_classes(kept).items() if c == i}
    left = spark.createDataFrame(list(kept.items()), "doc_id bigint, text string")
    found = {r.doc_id for r in leaks(left, load(spark, FOLDER, "benchmark")).collect()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, text in kept.items():
        if i not in found:
            ids = library.encode_ordinary(text)
            packed = b"".join(t.to_bytes(4, "little") for t in ids)
            want[i] = len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and len(got) > 50


def test_stages_keep_the_columns(spark):
    docs = load(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).schema.simpleString() == docs.schema.simpleString()


def test_stages_take_an_empty_table(spark):
    docs = load(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_stages_take_rows_with_odd_columns(spark):
    """Names that stages use themselves, repeated keys, nulls; every stage keeps the columns as they are."""
    names = ["score", "predicted", "n_lines", "n_removed", "__doc", "doc", "node", "row", "text_hash", "at", "a.b", "_text", "_key", "_label"]
    docs = load(spark, FOLDER, "documents")
    more = docs.limit(3).union(docs.selectExpr("null", "text", "lang", "source", "n_chars").limit(2)).union(
        docs.selectExpr("doc_id", "null", "null", "null", "null").limit(2))
    odd = docs.union(more).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns
        held = out.select(*[f"`{n}`" for n in names]).distinct().collect()
        assert [tuple(r) for r in held] == [tuple(f"own {n}" for n in names)]
    assert corpus_pipeline.STAGES[-1][1](spark, odd, FOLDER).count() == odd.count()


def test_texts_reach_python_in_small_batches(spark):
    """The stages with Python work bound an Arrow batch by its bytes, but keep a smaller bound of the user's."""
    name, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, before = load(spark, FOLDER, "documents"), {k: spark.conf.get(k) for k in (name, rows)}

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]}, pa.schema([("n", pa.int64())]))

    try:
        spark.conf.set(rows, "10000")
        for stage in (corpus_pipeline.keep_good, corpus_pipeline.encode):
            spark.conf.unset(name)
            stage(spark, docs, FOLDER)
            texts = spark.range(0, 2400, 1, 1).select(F.expr("repeat(cast(id as string), 5000)").alias("text"))
            found = [r.n for r in texts.mapInArrow(sizes, "n bigint").collect()]
            assert max(found) < 2 * common.BATCH_BYTES and sum(found) > 4 * common.BATCH_BYTES
            spark.conf.set(name, "1m")
            stage(spark, docs, FOLDER)
            assert spark.conf.get(name) == "1m"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_texts_are_mapped_in_small_pieces(spark):
    texts = spark.range(0, 300, 1, 1).select("id", F.expr("repeat('0123456789', 2000)").alias("text"))

    def make():
        return lambda some: [[sum(map(len, some))] * len(some)]

    rows = common.map_texts(texts, "text", make, "n bigint", ("id",)).collect()
    assert [r.id for r in rows] == list(range(300)) and max(r.n for r in rows) < 2 << 20

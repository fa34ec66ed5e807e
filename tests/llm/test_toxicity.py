import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import toxicity as tox

from .cases import empty, frame

BIG = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    rows = tox.op1_noisy_or(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    predicted = np.array([r["predicted"] for r in rows])
    assert ((s >= 0.3).astype(int) == predicted).all() and ((0 <= s) & (s <= 1)).all()
    assert auc(s, y) > 0.95
    assert y[predicted == 1].mean() > 0.9 and predicted[y == 1].mean() > 0.8


def test_folds_and_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["held_out"] for r in tox.op1_noisy_or(spark, sf).collect()}
    assert got == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs.select("doc_id").collect()}


def test_scores_do_not_depend_on_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in tox.judge(docs.repartition(n), x).collect()} for n, x in ((2, labels), (5, flipped)))
    assert a == b


def test_sentences_are_located(spark):
    clean, toxic = "All is well here today. We talk of rivers.", "All is well here today. You zorgish zorgful thing! We talk of rivers."
    rows = [(i, toxic if i % 3 == 0 else clean) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = tox.score_documents(docs, tox.train(docs, labels), with_spans=True).collect()
    for r in got:
        spans = [toxic.encode()[x["start"] : x["stop"]].decode() for x in r["offending"]]
        assert spans == (["You zorgish zorgful thing"] if r["doc_id"] % 3 == 0 else [])
        if r["doc_id"] % 3 == 0:
            assert (r["worst_start"], r["worst_stop"]) == (24, 49)


def test_noisy_or_equals_brute_force():
    texts = ["a b. c d! e", "", "x\ny", None, "été. ÀB, c"]
    bags = tox.Bags(pa.array(texts))
    rng = np.random.default_rng(0)
    model = tox.Weights(rng.normal(size=1 << tox.BITS).astype(np.float32), -1.0)
    z = model.sentences(bags.feature, bags.sentence, len(bags.doc))
    clean = model.clean(z, bags.doc, bags.n_docs)
    for i, t in enumerate(texts):
        one = tox.Bags(pa.array([t]))
        want = sum(-np.logaddexp(0, -1.0 + model.word[one.feature[one.sentence == s]].astype(float).sum()) for s in range(len(one.doc)))
        assert abs(clean[i] - want) < 1e-6
    assert np.bincount(bags.doc, minlength=5).tolist() == [3, 0, 2, 0, 2]


def test_edges(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (6, 0), (7, 1), (8, 0), (9, 1), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = tox.judge(df, labels).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert tox.judge(empty(spark), labels).count() == 0
    none = tox.judge(df, labels.filter("false")).collect()
    assert {r["predicted"] for r in none} == {0}

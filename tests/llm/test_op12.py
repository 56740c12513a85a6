import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm import op12_toxicity as op

from .conftest import prose


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def bucket(gram):
    """The bucket of one n-gram by whole numbers of any size."""
    h = 0
    for c in gram:
        h = h * 0x100000001B3 + ord(c)
    return ((h + len(gram)) * 0x9E3779B97F4A7C15 % 2**64 >> 44) % op.BUCKETS


def test_ngrams_once_with_borders():
    words = ["ab", "", "x", "ünï" * 4, "z🙂z"]
    for word, found in zip(words, op.buckets_of(words), strict=True):
        w = f"<{word}>"
        grams = {w[i : i + n] for n in range(op.SHORTEST, op.LONGEST + 1) for i in range(len(w) - n + 1)}
        assert set(np.frombuffer(found, np.int32).tolist()) == {bucket(g) for g in grams}
    assert op.buckets_of([]) == []
    features = op.Features()
    one, twice, none = features.of(["Bad bad_BAD", "bad", None])
    assert one.tolist() == twice.tolist() and len(none) == 0 and (np.diff(one) > 0).all()


def test_ratios_by_hand():
    op_ratio = op.log_ratios(np.array([40.0, 0.0, 5.0, 1.0]), np.array([2.0, 0.0, 50.0, 0.0]), 50, 500)
    a, b = 40 + op.SMOOTHING * 50 / 550, 2 + op.SMOOTHING * 500 / 550
    assert op_ratio[0] == pytest.approx(np.log(a / 50) - np.log(b / 500))
    # held by neither, by both alike, by one text alone
    assert op_ratio[1:].tolist() == [0, 0, 0]


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(30) < 0.3).astype(np.int32) for _ in range(200)]
    labels = np.array([int((0 in x) + (1 in x) - (2 in x) + rng.random() > 0.8) for x in rows])
    ratios = rng.normal(size=30)
    ratios[5] = 0
    model = op.fit(rows, labels, ratios, 1e-2)
    assert model.weights[5] == 0
    x = np.zeros((200, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r]
    x[:, 30] = 1
    v = np.r_[np.divide(model.weights, ratios, out=np.zeros(30), where=ratios != 0), model.intercept]
    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (200 - labels.sum()))
    slope = x.T @ (weight * (1 / (1 + np.exp(-x @ v)) - labels)) + 1e-2 * np.r_[v[:-1], 0]
    assert np.abs(np.delete(slope, 5)).max() < 2e-3


@pytest.fixture(scope="module")
def made(spark):
    """Prose, a fifth of it with words of one of two stems."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(700):
        words, toxic = prose(1000 + i, 90).split(" "), i % 5 == 2
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Gnarl", "gnarls,", "zwick" + rng.choice("aeiou"), "ZWICKEND"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(made):
    docs, labels = made
    rows = op.score(docs, op.train(docs, labels)).join(labels, "doc_id").collect()
    assert len(rows) == 700 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    apart = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in apart) >= 0.97 * len(apart)
    assert not any(r.predicted for r in apart if not r.toxic)


def test_held_out_labels_teach_nothing(spark, made):
    docs, labels = made
    turned = labels.withColumn("toxic", F.when(op.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = op.train(docs, labels), op.train(docs, turned)
    assert (one.weights == two.weights).all() and one.intercept == two.intercept
    only = labels.filter(op.held_out(F.col("doc_id")))
    assert op.train(docs, only) is None
    assert {r.score for r in op.score(docs, None).collect()} == {0.0}


def test_sample_is_bounded_and_clashing_labels_are_left_out(spark, made):
    docs, labels = made
    n = op.training_rows(docs, labels, 40).groupBy("toxic").count().collect()
    assert len(n) == 2 and all(20 <= r["count"] <= 65 for r in n)
    odd = labels.unionByName(labels.filter("toxic = 1").withColumn("toxic", F.lit(0))).unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None)], labels.schema))
    assert {r.toxic for r in op.training_rows(docs, odd).collect()} == {0}


def test_odd_rows(spark, odd, odd_rows, none, made):
    model = op.train(*made)
    rows = op.score(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    blank = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert blank == {model.score(np.zeros(0, np.int32))}
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert op.score(none, model).count() == 0 and op.train(none, made[1]) is None


def test_supplied_tables(spark):
    """Held-out rows of sf0.1: nine of ten toxic ones, one of a hundred clean ones at most."""
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = op.score(some, op.train(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)

"""The toxicity classifier: what it learns, and what swapped identity terms do to it."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terrane.llm import toxicity

from .rows import SCHEMA, awkward, prose, row

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=400, identity=None):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = prose(k, 30).split()
        if toxic:
            words.insert(rng.randrange(30), rng.choice(["blorg", "Snark", "fnord"]))
        if identity and rng.random() < (0.9 if toxic else 0.1):
            words.insert(rng.randrange(30), identity)
        docs.append(row(k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_learns_from_training_rows_only(spark):
    docs, labels = labelled(spark)
    train = F.col("doc_id") % 3 != 0
    model = toxicity.fit(docs, labels, train=train)
    got = {r.doc_id: r._score for r in toxicity.scored(docs, model).collect()}
    held = [k for k in got if k % 3 == 0]
    assert all((got[k] >= toxicity.THRESHOLD) == (k % 4 == 0) for k in held)
    flipped = labels.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))
    other = toxicity.fit(docs, flipped, train=train)
    assert np.array_equal(model.weights, other.weights) and model.bias == other.bias
    assert all(0 <= s <= 1 for s in got.values())


def test_swaps_are_charged(spark):
    docs, labels = labelled(spark, identity="muslim")
    column = pa.array(["a muslim reads", "a christian reads", "a muslim snark reads"])
    gaps = []
    for pairing in (0.0, 20.0):
        scores = toxicity.fit(docs, labels, pairing=pairing).scores(column)
        gaps.append(abs(scores[0] - scores[1]))
    assert gaps[1] < 0.5 * gaps[0]
    assert scores[2] >= toxicity.THRESHOLD > scores[0]


def test_descend_finds_the_minimum():
    sets = [np.array(s, int) for s in ([0], [0, 1], [1], [2], [2, 0], [])]
    y = np.array([1.0, 1, 0, 0, 1, 0])
    swaps = np.array([[0, 2]])

    def loss(w, b):
        z = np.array([w[s].sum() + b for s in sets])
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.5 * 0.05 * (w @ w) + 0.5 * (w[0] - w[2]) ** 2

    w, b = toxicity.descend(sets, y, 3, swaps, pairing=0.5, l2=0.05, steps=3000, rate=0.02)
    best = loss(w, b)
    rng = np.random.default_rng(1)
    assert all(loss(w + d[:3], b + d[3]) >= best - 1e-9 for d in rng.normal(0, 0.05, (200, 4)))


def test_counts_against_a_loop(spark):
    docs, labels = labelled(spark, 40)
    rows = toxicity.labelled(docs, labels, "doc_id", "text", "toxic")
    want = {}
    for r in rows.collect():
        for b in [*{toxicity.word_bucket(w.rstrip(".")) for w in r.text.split()}, -1]:
            n = want.setdefault(b, [0, 0])
            n[1 - r.y] += 1
    assert {r.bucket: [r.n1, r.n0] for r in toxicity.word_counts(rows).collect()} == want


def test_awkward_and_empty(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 1), (3, 1, None), (None, 1, 1), (5, 0, 0), (7, 1, 0)], LABELS)
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r._score <= 1 for r in got)
    assert len({r._score for r in got if r.doc_id in (2, 3, 4)}) == 1
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    none = toxicity.fit(docs, labels.filter("false"))
    assert {r._score for r in toxicity.scored(docs, none).collect()} == {toxicity.Model(none.place, none.weights, -500.0).scores(pa.array([""]))[0]}
    assert toxicity.clean(docs.filter("false"), labels).count() == 0

"""Naive Bayes against a dictionary version, and what it predicts."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import language

from .rows import SCHEMA, awkward, row

SAMPLES = {"en": "the cat with the hat that this and other things were there {}", "de": "der hund und die katze sind nicht über den zaun gesprungen {}",
           "fr": "le chien était dans la maison où nous avons mangé les pommes {}"}


def corpus(spark, n=60):
    rows = [row(k, SAMPLES[lang].format(k), lang, "s") for k in range(n) for lang in [sorted(SAMPLES)[k % 3]]]
    return spark.createDataFrame(rows, SCHEMA)


def slow(texts, query):
    """Scores by counting bucket by bucket in dictionaries."""
    def buckets(text):
        points, offsets = language.characters(pa.array([text]))
        return language.grams(points, offsets)[1].tolist()

    scores = {}
    for lang, mine in texts.items():
        counts = {}
        for text in mine:
            for b in buckets(text):
                counts[b] = counts.get(b, 0) + 1
        total = sum(counts.values()) + language.SMOOTHING * language.BUCKETS
        prior = math.log(len(mine) / sum(map(len, texts.values())))
        scores[lang] = prior + sum(math.log((counts.get(b, 0) + language.SMOOTHING) / total) for b in buckets(query))
    top = max(scores.values())
    best = max(sorted(scores), key=scores.get)
    return best, 1 / sum(math.exp(s - top) for s in scores.values())


def test_against_dictionaries(spark):
    docs = corpus(spark)
    train = F.col("doc_id") % 4 != 2
    model = language.fit(docs, train=train)
    texts = {}
    for r in docs.filter(train).collect():
        texts.setdefault(r.lang, []).append(r.text)
    queries = ["the cat", "die katze über", "où est la maison", "x y", "ça 漢字"]
    names, scores = model.predict(pa.array(queries))
    for query, name, score in zip(queries, names, scores, strict=True):
        want, p = slow(texts, query)
        assert name == want and score == pytest.approx(p, rel=1e-9)


def test_grams_stay_in_their_text():
    alone = [language.grams(*language.characters(pa.array([t])))[1].tolist() for t in ("ab", "cde", "")]
    row_, bucket = language.grams(*language.characters(pa.array(["ab", "cde", ""])))
    assert [sorted(bucket[row_ == k].tolist()) for k in range(3)] == [sorted(a) for a in alone]
    assert len(alone[1]) == 6


def test_held_out_accuracy(spark):
    docs = corpus(spark, 90)
    model = language.fit(docs, train=F.col("doc_id") % 4 != 2)
    got = language.identified(docs, model).filter("doc_id % 4 = 2").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)


def test_awkward_and_empty(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).withColumn("score", F.lit("old"))
    model = language.fit(docs)
    got = language.identified(docs, model).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got if r.text is None or not r.text.strip()} == {"und"}
    assert all(r.lang_pred in model.languages for r in got if r.text and r.text.strip())
    assert model.languages == ["de", "en", "fr"]
    nothing = language.fit(docs.filter("false"))
    assert {(r.lang_pred, r.score) for r in language.identified(docs, nothing).collect()} == {("und", 0.0)}
    assert language.identified(docs.filter("false"), model).count() == 0
    digits = language.Model(["a"], np.zeros(1), np.zeros((1, language.BUCKETS)))
    assert digits.predict(pa.array(["123 !?", None, "1a"]))[0] == ["und", "und", "a"]

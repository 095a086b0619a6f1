"""PPM against a trie of dictionaries, and the word model against its formula."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import ppm

from .rows import SCHEMA, awkward, prose, row


def padded(text):
    return bytes([ppm.BEFORE]) * ppm.ORDER + (text or "").encode().lower() + bytes([ppm.END])


class SlowTrie:
    """Walks contexts byte by byte, with method C escapes and exclusion of all bytes offered before."""

    def __init__(self, texts):
        self.children = {}
        for text in texts:
            data = padded(text)
            for at in range(ppm.ORDER, len(data)):
                for n in range(ppm.ORDER + 1):
                    self.children.setdefault(data[at - n : at], Counter())[data[at]] += 1

    def log10(self, text):
        total, data = 0.0, padded(text)
        for at in range(ppm.ORDER, len(data)):
            excluded = set()
            for n in range(ppm.ORDER, -1, -1):
                counts = self.children.get(data[at - n : at])
                if counts is None:
                    continue
                left = {b: c for b, c in counts.items() if b not in excluded}
                below = sum(left.values()) + len(left)
                if data[at] in left:
                    total += math.log10(left[data[at]] / below)
                    break
                if below:
                    total += math.log10(len(left) / below)
                excluded |= set(counts)
            else:
                total -= math.log10(256 - len(excluded))
        return total


def prices_of(spark, texts, queries):
    """Prices of the runs of all texts, learned from `texts` alone."""
    frame = spark.createDataFrame([(t, True) for t in texts] + [(q, False) for q in queries], "text string, learnt boolean")
    counts = ppm.corpus_counts(frame).filter(F.col("kind") == ppm.GRAM)
    return {r.key: r.price for r in ppm.run_prices(counts).collect()}


def test_prices_against_slow_trie(spark, monkeypatch):
    texts = [prose(k, 20) for k in range(6)] + ["Ünïcödé", "", None, "aaaa aaaa"]
    queries = [prose(3, 20), prose(50, 9), "zzz qqq", "", None, "日本", "Ünï"]
    slow = SlowTrie(texts)
    for held in (ppm._PRICED, 1):  # the second decides a few groups at a time
        monkeypatch.setattr(ppm, "_PRICED", held)
        prices = prices_of(spark, texts, queries)
        keys, offsets = ppm.grams(pa.array(queries))
        got = ppm.row_sums(np.array([prices[int(k)] for k in keys]), offsets)
        assert got == pytest.approx([slow.log10(q) for q in queries], rel=1e-9)


def test_rare_runs_stay(spark):
    """A run that stands twice in a corpus is learned, however large the rest is."""
    rare = "quixotic zephyr"
    prices = prices_of(spark, ["the " * 100_000, rare, rare], [])
    keys, _ = ppm.grams(pa.array([rare]))
    assert [prices[int(k)] for k in keys[5:]] == pytest.approx([math.log10(2 / 3)] * len(keys[5:]))


def test_probabilities_of_a_context_sum_to_one(spark):
    levels = []
    keys = np.concatenate([ppm.grams(pa.array([prose(k, 60)]))[0] for k in range(5)])
    for order in range(ppm.ORDER + 1):
        levels.append(ppm.level(keys, np.ones(len(keys)), levels[-1] if levels else None, order))
    for context in (b"birch"[: ppm.ORDER], b"qqqqqqq"[: ppm.ORDER], bytes([ppm.BEFORE]) * ppm.ORDER):
        base = int.from_bytes(context, "big") << 8
        runs = np.array([base + b for b in range(256)], np.uint64)
        assert 10.0 ** ppm.Trie(levels).log10(runs) @ np.ones(256) == pytest.approx(1.0)


def test_documents(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 1
    learnt = [r.text for r in docs.filter(train).collect()]
    counts = Counter()
    for text in learnt:
        counts.update([*(text or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    slow = SlowTrie(learnt)
    for share in (ppm.SHARE, 20):  # the second leaves most runs and words to the join
        got = ppm.scored(docs, train=train, share=share).collect()
        assert len(got) == docs.count()
        of = {r.doc_id: r for r in docs.collect()}
        for r in got:
            if r.doc_id is None:
                continue
            tokens = [*(of[r.doc_id].text or "").encode().lower().split(), None]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel=1e-9)
            assert r.score == pytest.approx(slow.log10(of[r.doc_id].text), rel=1e-9)
    one = {r.doc_id: r.score for r in got}
    assert one[2] == one[3]


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([row(1, "ab"), row(2, None)], SCHEMA)
    got = {r.doc_id: r for r in ppm.scored(docs, train=F.lit(False)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(256)) and got[2].base_score == 0.0 and got[1].n_known == 0
    assert ppm.scored(docs.filter("false")).count() == 0

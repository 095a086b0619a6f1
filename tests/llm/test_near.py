"""Near copies against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import near, simhash

from .rows import SCHEMA, awkward, prose, row
from .test_simhash import roots


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1 if w else 0))


def edited(text, seed, edits):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
    return " ".join(w)


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    texts = [prose(k, 40 + 7 * k) for k in range(30)]
    texts += [edited(texts[k % 30], k, 1 + k % 5) for k in range(120)]  # on both sides of the bound
    texts += ["one two", "One  TWO", "one", "a b c d e", "a b c d e f", "", None, " "]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("part_rows", [1024, 2])
def test_against_all_pairs(spark, part_rows):
    docs = corpus()
    sets = {k: shingles(t) for k, t in docs}
    pairs = [(a, b) for a in sets for b in range(a) if similar(sets[a], sets[b])]
    assert len(pairs) > 50
    got = near.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), part_rows=part_rows)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(roots(list(sets), pairs).values()))


def test_links_of_a_large_group(spark):
    """Thousands of near copies over many parts: links in proportion to the rows, and one group."""
    base = prose(77, 60)
    texts = list(dict.fromkeys([base, *[edited(base, k, 1) for k in range(5200)]]))[:4900] + [prose(78, 60), edited(prose(78, 60), 1, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.lit(False).alias("empty"), "text")
    sketches = near._sketches(marked, near.SHINGLE).select("fp", "n", "bands", F.struct("empty", "id", "h").alias("c"))
    links = near.similar(sketches, marked, part_rows=256)
    buckets = sketches.select(F.explode("bands").alias("key")).groupBy("key").count()
    assert buckets.filter("count > 2000").count() > 2
    # the links of a bucket are fewer than its rows, so all are fewer than the rows of all buckets, of which some parts are equal
    assert links.count() < 2 * buckets.filter("count > 1").agg(F.sum("count")).first()[0]
    got = near.deduplicated(docs, part_rows=256)
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    first = sorted(r.doc_id for r in got.collect())
    assert len(first) < 50 and set(first) >= {0, len(texts) - 2}
    alone = [k for k in first if k not in (0, len(texts) - 2)]
    assert all(not similar(sets[k], sets[j]) for k in alone for j in sets if j != k)


def test_pairs_stay_fewer_than_rows():
    """Two parts of copies of one group: one pair for each set of connected rows that a row meets."""
    for n in (20, 40, 160):
        sizes, codes = np.full(2 * n, 10), np.tile(np.arange(10, dtype=np.uint64), 2 * n)
        side = np.repeat([0, 1], n)
        left, right, label = near.linked(side, sizes, codes)
        assert len(left) == 2 * n - 1 and not label.any()
        left, right, _ = near.linked(side, sizes, codes, group=side)
        assert len(left) == 1
        left, right, _ = near.linked(np.zeros(2 * n, int), sizes, codes)
        assert len(left) == 2 * n - 1


def test_stage_of_the_pipeline_follows_the_similarity(spark):
    """Near copies that differ in more than six bits go, unlike texts with near fingerprints stay."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    pairs = [(a, b) for a in sets for b in sets if b < a and similar(sets[a], sets[b])]
    got = corpus_pipeline.near_dedup_stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(roots(list(sets), pairs).values()))


def test_awkward_and_repeated_ids(spark):
    docs = spark.createDataFrame([*awkward(), row(20, edited(prose(9, 60_000), 1, 3)), row(1, "Alone here under an id that repeats")], SCHEMA)
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 1, 2, 5, 7, 9, 10, 11] and ids.count(None) == 1
    assert near.deduplicated(docs.filter("false")).count() == 0


def test_copies_without_ids(spark):
    text = prose(3, 200)
    docs = spark.createDataFrame([(None, text), (None, edited(text, 1, 2)), (None, text), (None, prose(4, 50))], "doc_id long, text string")
    assert near.deduplicated(docs).count() == 2


def test_fingerprints_name_candidates(spark):
    """Operator 8's links are a bucket of the stage, and the exact check is made without any MinHash bucket."""
    texts = [prose(k, 300) for k in range(6)]
    texts += [" ".join(t.split()[:-1] + [f"end{k}"]) for t in texts for k in range(4)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("h", F.xxhash64("text")).withColumn("empty", F.lit(False))
    docs = docs.select("id", "h", "empty", "text")
    prints = {k: simhash.fingerprint((t or "").encode()) for k, t in enumerate(texts) if t}
    want = roots(list(prints), [(a, b) for a in prints for b in prints if b < a and (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS])
    assert 6 <= len(set(want.values())) < len(want)
    rows = near._sketches(docs, near.SHINGLE)
    by = {r.fp: r.key for r in near.by_print(rows).collect()}
    fps = {r.id: r.fp for r in rows.collect()}
    assert {(a, b) for a in want for b in want if by[fps[a]] == by[fps[b]]} == {(a, b) for a in want for b in want if want[a] == want[b]}
    sketches = rows.select("fp", "n", F.array().cast("array<long>").alias("bands"), F.struct("empty", "id", "h").alias("c"))
    found = near.similar(sketches, docs, more=near.by_print(rows)).collect()
    ids = {fp: k for k, fp in fps.items()}
    assert roots(list(prints), [(ids[r.a], ids[r.b]) for r in found]) == want

"""Decontamination against a search window by window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terrane.llm import decontaminate

from .rows import SCHEMA, awkward, prose, row


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit.update(range(p, p + n))
                        names.add(str(name))
        out.append((doc_id, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=repr)


def found(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.matches(d, b, **settings).select("doc_id", "_found.n_words", decontaminate.hit_words(F.col("_found")), "_found.items")
    return sorted(((r[0], r[1], r[2], tuple(r[3])) for r in rows.collect()), key=repr)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["ab", "Ba", "c9", "dé", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ", ", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(8)] + [(90, ""), (91, None), (92, "... !")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(30)]
    docs += [(100 + k, f"{text(7)} {item}! {text(5)}") for k, (_, item) in enumerate(items) if item] + [(200, None), (201, "")]
    return docs, items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = case(seed)
        assert found(spark, docs, items) == brute(docs, items)


def test_blocks_of_the_benchmark_agree(spark):
    docs, items = case(9)
    assert found(spark, docs, items, block_characters=40) == brute(docs, items)


def test_benchmark_beyond_the_bound_is_an_error(spark, monkeypatch):
    docs, items = case(9)
    monkeypatch.setattr(decontaminate, "MOST_CHARACTERS", 50)
    with pytest.raises(ValueError):
        found(spark, docs, items)


def test_longest_match(spark):
    item = prose(3, 40)
    docs = spark.createDataFrame([(1, prose(4, 20) + " " + " ".join(item.split()[5:30]) + " " + prose(5, 20)), (2, prose(6, 50))], "doc_id long, text string")
    got = {r[0]: r[1] for r in decontaminate.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id", "_found.longest").collect()}
    assert got == {1: 25, 2: 0}


def test_awkward_and_empty(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    items = spark.createDataFrame([(1, prose(1, 100)), (None, prose(5, 60)), (2, None)], "item_id long, text string")
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 3, 4, None, 7, 7, 9, None, 10, 11], key=repr)
    assert decontaminate.decontaminated(docs.filter("false"), items).count() == 0
    assert decontaminate.decontaminated(docs, items.filter("false")).count() == docs.count()


def test_clean_neighbours_stay(spark):
    item = prose(3, 30)
    docs = spark.createDataFrame([row(1, " ".join(item.split()[:9])), row(2, prose(8, 200)), row(3, "x " + item)], SCHEMA)
    kept = decontaminate.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_benchmark_beyond_the_bound_is_searched_in_passes(spark, monkeypatch):
    docs, items = case(9)
    monkeypatch.setattr(decontaminate, "MOST_CHARACTERS", 50)
    monkeypatch.setattr(decontaminate, "PASS_CHARACTERS", 150)
    d = spark.createDataFrame([*docs, *docs[-3:]], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches_in_passes(d, b, block_characters=40)
    assert got.columns == ["doc_id", "text", "_found"]
    rows = got.select("doc_id", "_found.n_words", decontaminate.hit_words(F.col("_found")), "_found.items").collect()
    assert sorted(((r[0], r[1], r[2], tuple(r[3])) for r in rows), key=repr) == brute([*docs, *docs[-3:]], items)
    whole = {r.doc_id: r._found.longest for r in decontaminate.matches_in_passes(d, b, pass_characters=10**6).collect()}
    assert {r.doc_id: r._found.longest for r in got.collect()} == whole
    hit = {r[0] for r in brute(docs, items) if r[2]}
    assert {r.doc_id for r in decontaminate.decontaminated(d, b).collect()} == {k for k, _ in docs} - hit

"""Mixing against its rules, and water filling against a loop."""

import random

import pytest

from terrane.llm import mixing

from .rows import SCHEMA, awkward, prose, row


def targets(spark, sizes):
    rows = spark.createDataFrame(sizes, "source string, size long")
    return {r.source: (r.source_size, r.target) for r in mixing.source_targets(rows).collect()}


def by_loop(sizes, weights=(5, 2, 1)):
    """Share out, cut off, share the excess among the others until none is above."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    whole, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in capped]
        left, total = whole - sum(capped.values()), sum(weight[n] for n in free)
        target = {n: left * weight[n] / total for n in free} if free else {}
        above = [n for n in free if target[n] > 2 * sizes[n]]
        if not above:
            return capped | target
        capped |= {n: 2.0 * sizes[n] for n in above}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 3, 50, 1000, 20_000]) for k in range(rng.randint(1, 9))} | {None: 70}
    got = targets(spark, list(sizes.items()))
    want = by_loop(sizes)
    assert {n: s for n, (s, _) in got.items()} == sizes
    assert all(abs(got[n][1] - want[n]) < 1e-6 * max(1, want[n]) for n in sizes)


def test_mix_is_near_target_and_repeats(spark):
    docs = spark.createDataFrame([row(k, prose(k, 1 + k * k % 90), "en", "abc"[k % 7 % 3]) for k in range(400)], SCHEMA)
    got = mixing.mixed_sources(docs).collect()
    for source in "abc":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * max(r.size for r in mine)
        assert sum(r.size for r in mine) == mine[0].source_size
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    again = mixing.mixed_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    assert mixed.count() == sum(r.copies for r in got)


def test_offset_moves_the_choice(spark):
    docs = spark.createDataFrame([row(k, "one two", "en", "abc"[k % 3]) for k in range(60)], SCHEMA)
    picks = {seed: sorted(r.doc_id for r in mixing.mixed_sources(docs, seed=seed).filter("copies = 2").collect()) for seed in (1, 2, 3)}
    assert len({tuple(p) for p in picks.values()}) > 1


def test_awkward_and_empty(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    got = mixing.mixed_sources(docs).collect()
    assert len(got) == docs.count()
    assert {r.size for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert all(r.copies <= 2 for r in got)
    assert set(mixing.mix(docs).columns) == {*docs.columns, "copy"}
    assert mixing.mix(docs.filter("false")).count() == 0

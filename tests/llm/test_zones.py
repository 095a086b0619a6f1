"""Hard negatives against all scores, bounds and the curve against their definitions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm import zones

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(c, T.StringType()) for c in ("id", "vector", "anchor", "block", "kind", "group")]])


def by_scores(rows, positives=5, negatives=5):
    """(anchor, positive, rank, negative, scores) from the scores of all pairs."""
    width = max([1, *(len(v) for _, v, _ in rows)])
    vectors = np.zeros((len(rows), width), object)
    for k, (_, v, _) in enumerate(rows):
        vectors[k, : len(v)] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
    out = []
    for a, (i, _, label) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = sorted((-int(vectors[a] @ vectors[b]), j is None, j or 0, k) for b, (j, _, k) in enumerate(rows) if j is None or j != i)
        same, other = [s for s in scored if s[3] == label], [s for s in scored if s[3] != label]
        for p, none, j, _ in same[:positives]:
            good = [s for s in other if 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(i, None if none else j, rank, None if s[1] else s[2], -p, -s[0]) for rank, s in enumerate(good, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)
    got = zones.hard_negatives(frame, "vec_id", F.col("label"), "embedding", F.col("vec_id") % 100 == 0, **settings)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def clustered(seed, n, width=6, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    of = rng.integers(0, clusters, n)
    vectors = (centres[of] + 0.15 * rng.normal(size=(n, width))).astype(np.float32)
    return [(int(k * 10), v.tolist(), int(rng.integers(0, 4))) for k, v in enumerate(vectors)]


@pytest.mark.parametrize("settings", [{}, {"block_rows": 16, "bucket_blocks": 4, "group": 3}], ids=["one block", "many blocks"])
@pytest.mark.parametrize("seed", range(2))
def test_against_all_scores(spark, seed, settings):
    rows = clustered(seed, 600)
    want = by_scores(rows)
    assert len(want) > 300
    assert mined(spark, rows, **settings) == want


def test_awkward(spark):
    vector = [0.5, -0.25, 1.0]
    rows = [(100 * k, vector, k % 3) for k in range(40)]  # a vector of many rows: all ties
    rows += [(100, [0.3, 0.2, 0.9], 1), (7, [], 1), (8, [0.1], 2), (None, [0.5, 0.0, 1.0], 0), (None, [0.5, 0.0, 1.0], 1), (3, [1e30, 0.0, 0.0], 2), (4, [-0.0, -1e-9, 0.0], 1)]
    rows = [r for r in rows if r[0] != 3]  # a component beyond the limit has a case of its own
    bad = [(200, None, 1), (300, [1.0, None, 0.0], 1), (400, [float("nan")] * 3, 1), (500, [float("inf"), 0.0, 0.0], 1), (600, vector, None)]
    assert mined(spark, rows + bad, block_rows=8, bucket_blocks=2, group=4) == by_scores(rows)
    assert mined(spark, []) == [] and mined(spark, bad) == []
    assert mined(spark, [(100, vector, 1)]) == []
    assert mined(spark, [(100, [1e30, 1e30], 1), (1, [1e30, -1e30], 1), (2, [1e30, -1e29], 2)]) == [(100, 1, 1, 2, 0, 0)]


def test_blocks_are_left_out(spark):
    """Far clusters lie in blocks that the zone maps rule out."""
    rows = clustered(3, 2000, width=3, clusters=12)
    frame = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    packed, width = zones.blocks(zones.usable(frame), block_rows=32, bucket_blocks=8)
    groups = zones.anchor_groups(packed, width, 8)
    first = zones.chosen(packed, groups, width, 1, True, seeds=6)
    found = zones.searched(packed, groups, first, width, 1, True, 5)

    def floors(n, at, rank, score):
        least = np.full((n, 1), np.iinfo(np.int64).min)
        least[at[rank == 4], 0] = score[rank == 4]
        return least, np.full((n, 1), np.iinfo(np.int64).max)

    wanted = zones.chosen(packed, zones._windows(groups, found, floors), width, 1, True)
    read = wanted.select(F.sum(F.size("wanted"))).first()[0]
    assert read < 0.5 * packed.count() * groups.count()


@pytest.mark.parametrize("width,bits", [(2, 3), (3, 2), (5, 2), (4, 1)])
def test_curve_goes_from_neighbour_to_neighbour(width, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
    place = zones.curve(cells, bits)
    order = sorted(range(len(cells)), key=lambda k: place[k].tobytes())
    assert len({p.tobytes() for p in place}) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    vectors, anchors = rng.integers(-300, 300, (40, 7)), rng.integers(-300, 300, (9, 7))
    low, high = zones.bounds(anchors, vectors.min(0)[None], vectors.max(0)[None])
    score = anchors @ vectors.T
    assert (low <= score).all() and (score <= high).all()
    corner = np.where(anchors > 0, vectors.max(0), vectors.min(0))
    assert (high[:, 0] == (anchors * corner).sum(1)).all()
    big = np.full((2, 3), 1 << 23)
    assert (zones.product(big * 64, big * 64) == 3 << 58).all()


def test_steps_of_sliced_and_empty_lists():
    column = pa.array([[9.0], [0.5, -0.001], [], [1.0, 2.0, 3.0]], pa.list_(pa.float32())).slice(1)
    assert zones.steps(column, 3).tolist() == [[128, -1, 0], [0, 0, 0], [256, 512, 768]]

"""SimHash against its definition, comparison of all pairs and union-find."""

import random

import numpy as np
import xxhash

from terrane.llm import components, simhash

from .rows import SCHEMA, awkward, prose, row


def by_definition(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def near_prints(seed, groups=60):
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 3, 40])):
            out.add(base)
            for _ in range(rng.randint(0, 5)):
                base ^= 1 << rng.randrange(64)
    return sorted(out)


def test_fingerprint():
    for text in ("", " ", "One", "one two", "one two three", prose(1, 50), "Ä Ö ü ß É", "a a a a a a", prose(2, 5000)):
        assert simhash.fingerprint(text.encode()) == by_definition(text)


def test_distances_by_planes():
    rng = np.random.default_rng(3)
    left = rng.integers(0, 2**63, (5, 64)).astype(np.uint64)
    right = left.copy()
    for k in range(64):
        for b in rng.integers(0, 64, k % 12):
            right[:, k] ^= np.uint64(1) << np.uint64(b)
    for radius in range(5):
        got = simhash.near(simhash._transposed(right.ravel()), left, radius)
        for block in range(5):
            want = np.bitwise_count(left[block][:, None] ^ right[block][None, :]) <= radius
            bits = (got[block][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            assert (bits.astype(bool) == want).all()


def test_links_against_all_pairs(spark):
    for part_rows, radius in ((1024, 3), (8, 3), (1024, 6), (8, 6), (1024, 0)):  # small parts cut the buckets
        prints = near_prints(part_rows)
        frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(frame, radius, part_rows).collect()]
        pairs = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= radius]
        assert (pairs or not radius) and roots(prints, links) == roots(prints, pairs)


def test_components(spark):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(70)] + [(1000, 1000 + k) for k in range(1, 50)]
    random_edges = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    edges = chain + random_edges + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({n for e in edges if e[0] != e[1] for n in e}, edges)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([*awkward(), row(20, prose(9, 60_000).replace("oak1", "elm1", 1)), row(21, "Alone here")], SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, r.component_id)
    assert of[8] == 1 and of[1] == 1 and of[20] == 9 and of[21] == 21 and of[3] == of[4] == 2 and of[7] == 7
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 9, 10, 11, 21] and ids.count(None) == 1
    assert simhash.deduplicated(docs.filter("false")).count() == 0

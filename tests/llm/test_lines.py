"""Line dedup against its rules, and the perfect hash against a dictionary."""

import hashlib
import re

import numpy as np
import pytest

from terrane.llm import lines

from .rows import SCHEMA, awkward, prose, row

SOLID = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def by_rules(docs, least=40, many=5):
    """(id, n_lines, n_dropped, text) of each row, counted line by line."""
    key = lambda line: SOLID.sub("", line).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for n, (i, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), {})[n] = i
    keeper = {k: max((i for i in rows.values() if i is not None), default=None) for k, rows in held.items() if len(rows) >= many}
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def corpus():
    shared = [prose(900 + k, 12).replace("\n", " ") for k in range(40)]
    docs = []
    for k in range(120):
        own = [prose(k * 7 + j, 3 + j).replace("\n", " ") for j in range(k % 5)]
        more = [(f" \t{s.upper()}\x0b" if (k + n) % 3 == 0 else s) for n, s in enumerate(shared) if (k * 31 + n * 17) % 40 < n // 4]
        docs.append((k % 110 if k % 13 else None, "\n".join([*own, *more, *more[:1], "short line", ""])))
    # just below and at both bounds, in characters of two bytes too
    docs += [(500 + k, "é" * 39 + "\n" + "é" * 40 + "\n" + "x" * 40 * (k < 4)) for k in range(5)]
    return docs


def outcome(found):
    return sorted(((r["row"]["doc_id"], r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=repr)


@pytest.mark.parametrize("broadcast_bytes", [lines.BROADCAST_BYTES, -1], ids=["arrays to documents", "codes to shards"])
@pytest.mark.parametrize("shard_keys", [lines.SHARD_KEYS, 3])
def test_against_rules(spark, broadcast_bytes, shard_keys):
    docs = corpus()
    want = by_rules(docs)
    assert sum(w[2] for w in want) > 100
    got = lines.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), broadcast_bytes=broadcast_bytes, shard_keys=shard_keys)
    assert outcome(got) == sorted(want, key=repr)


@pytest.mark.parametrize("broadcast_bytes", [lines.BROADCAST_BYTES, -1])
def test_awkward(spark, broadcast_bytes):
    extra = [row(20 + k, "A line that stands in all of these documents, as it must\n" * 3) for k in range(5)]
    extra += [row(None, "Only documents without an id hold this line of some length\nown") for _ in range(6)]
    docs = spark.createDataFrame([*awkward(), *extra], SCHEMA)
    got = lines.deduplicated(docs, broadcast_bytes=broadcast_bytes)
    assert got.columns == docs.columns
    want = by_rules([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((w[0], w[3]) for w in want), key=repr)
    assert sum(w[2] for w in want) == 12  # three lines of four documents; those without ids keep theirs
    assert lines.deduplicated(docs.filter("false"), broadcast_bytes=broadcast_bytes).count() == 0


def test_ids_of_another_type(spark):
    docs = [(f"d{k}", "This line is long enough to be counted, I should think\n" + str(k)) for k in range(6)]
    got = lines.deduplicated(spark.createDataFrame(docs, "doc_id string, text string"))
    assert sorted(r.doc_id for r in got.collect() if "\n" in r.text) == ["d5"]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    codes = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    sizes, bits = lines.perfect_hash(codes)
    shard = lines.Shard(np.array(sizes, np.int64), bits.tobytes(), b"", b"", None)
    assert sorted(shard.index(codes).tolist()) == list(range(len(codes)))
    assert sum(sizes) <= 5 * len(codes) + 64
    others = np.random.default_rng(n + 1).integers(0, 2**64, 500, np.uint64)
    assert (shard.index(others) < max(1, len(codes))).all()


def test_query(spark):
    from terrane.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, text in by_rules(docs)]
    got = [tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in QUERIES["op12_line_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(want)

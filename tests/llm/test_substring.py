"""Substring dedup against all windows of words."""

import random

import numpy as np
import pyarrow as pa

from terrane.llm import substring

from .rows import SCHEMA, awkward, prose, row


def test_gear_hash():
    texts = [prose(1, 40), "", "ab", prose(2, 7)]
    column = pa.array(texts)
    data, offsets = substring.buffers(column)
    got = substring.gear(data, offsets)
    for k, text in enumerate(texts):
        h = 0
        for n, byte in enumerate(text.encode()):
            h = ((h << 1) + int(substring._GEAR[byte])) % 65536
            assert got[offsets[k] + n] == h


def test_chunks_resist_shifts():
    text = prose(4, 400)
    digests = [set(substring.chunks(pa.array([t]))[3].tolist()) for t in (text, "some new words " + text)]
    assert len(digests[0] & digests[1]) >= len(digests[0]) - 2


def planted(seed, docs=40):
    rng = random.Random(seed)
    passages = [prose(10_000 + seed * 10 + k, rng.choice([52, 60, 90, 200])) for k in range(5)]
    rows, has = [], {}
    for k in range(docs):
        parts = [prose(seed * 500 + k, rng.randint(15, 80))]
        if k % 3 == 0:
            p = rng.randrange(5)
            parts += [passages[p], prose(seed * 500 + 200 + k, rng.randint(15, 60))]
            has[k] = p
        rows.append(row(k, " ".join(parts)))
    return rows, has, passages


def test_planted_passages(spark):
    for seed in (1, 2):
        rows, has, passages = planted(seed)
        docs = spark.createDataFrame(rows, SCHEMA)
        got = {r.doc_id: r for r in substring.without_repeats(docs).select("row.doc_id", "text", "n_words", "n_removed", "spans").collect()}
        seen = set()
        for k in sorted(got):
            original = rows[k][1]
            if k in has and has[k] in seen:
                passage = passages[has[k]].split()
                assert " ".join(passage) not in " ".join(got[k].text.split()), k
                # all but some words at its start, and at most a word or two that agree by chance beyond
                assert len(passage) - 20 <= got[k].n_removed <= len(passage) + 2
            else:
                assert got[k].text == original and got[k].n_removed == 0
            seen.add(has.get(k))


def test_removed_bytes_follow_spans(spark):
    rows, _, _ = planted(3)
    for r in substring.without_repeats(spark.createDataFrame(rows, SCHEMA)).select("row.text", "text", "spans").collect():
        words = r[0].split()
        left = [w for k, w in enumerate(words) if not any(s.begin <= k < s.end for s in r.spans)]
        assert r[1].split() == left


def test_spans():
    chunk = lambda pos, n, before=0, after=0: {"pos": pos, "n": n, "before": before, "after": after}
    assert substring.spans_of([chunk(10, 20), chunk(30, 20)], 100, 40) == [(10, 50)]
    assert substring.spans_of([chunk(10, 20), chunk(40, 19)], 100, 20) == [(10, 30)]
    assert substring.spans_of([chunk(10, 20, 16, 4), chunk(34, 20, 2, 16)], 60, 40) == [(0, 60)]
    assert substring.spans_of([], 9, 1) == []


def test_bitmap_has_no_false_negatives():
    digests = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    size = 1 << 16
    bits = np.zeros(size // 64, np.uint64)
    for at in substring._bits(digests, size):
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    assert substring.in_bitmap(bits, digests).all()
    assert substring.in_bitmap(bits, digests + np.uint64(1)).mean() < 0.1


def test_awkward_and_empty(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    kept = substring.deduplicated(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = kept.collect()
    ids = [r.doc_id for r in got]
    assert 8 not in ids and ids.count(7) == 2 and ids.count(None) == 2  # 8 repeats 1; equal rows are one document
    assert {r.doc_id: r.text for r in got}[2] is None and {r.doc_id: r.text for r in got}[4] == " \n\t "
    assert {r.doc_id: r.text for r in got}[9] == prose(9, 60_000)
    assert substring.deduplicated(docs.filter("false")).count() == 0


def test_bitmap_reaches_the_driver_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WORDS", 1 << 8, raising=False)
    digests = np.random.default_rng(2).integers(-(2**63), 2**63, 9_000)
    frame, brought = spark.createDataFrame([(int(d),) for d in digests], "d long").repartition(5), []
    kind = type(frame)
    for name, rows in (("collect", len), ("toPandas", len), ("toArrow", lambda found: found.num_rows)):
        monkeypatch.setattr(kind, name, lambda self, get=getattr(kind, name), rows=rows: brought.append(rows(out := get(self))) or out)
    bits = substring.bitmap(frame, len(digests))
    expected = np.zeros(len(bits), np.uint64)
    for at in substring._bits(digests.view(np.uint64), 64 * len(bits)):
        np.bitwise_or.at(expected, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    assert (bits == expected).all() and len(bits) == 1 << 12
    assert sum(brought) <= 16  # a row for each block, not for each word of the bitmap
    assert not substring.bitmap(frame.limit(0), 0).any()

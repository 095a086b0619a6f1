"""Counts, sketches and limits against plain Python."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from terrane.llm import quality

from .rows import SCHEMA, awkward, prose, row


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                covered.update(range(p, p + 8))
    return dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)), n_lines=len(lines),
                n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered), n_punctuation=len(re.findall(r"[!-/:-@\[-`{-~]", text)),
                n_capitals=len(re.findall("[A-Z]", text)))


def test_counts():
    rng = random.Random(2)
    texts = ["", None, " \n \n", "a b c\na b c\n\nx # $", "Ünï 漢字 😀 *", prose(1, 30) + "\n" + prose(1, 30), "w " * 40]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\t", "ab ab "]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    got = quality.counts(pa.array(texts))
    for k, text in enumerate(texts):
        assert {c: int(v[k]) for c, v in got.items()} == slow_counts(text), text


def test_bucket_and_quantiles(spark):
    values = [0, 1, 2, 255, 256, 257, 511, 513, 100_000]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v"))).collect()]
    assert got == [0, 1, 2, 255, 256, 256, 510, 512, 99_840]


def test_merged_sketch_equals_sketch_of_all(spark):
    rows = [("en", s, "symbols", b, n) for s, b, n in (("a", 1, 5), ("a", 3, 5), ("b", 1, 2), ("b", 9, 8))]
    sketch = spark.createDataFrame(rows, "lang string, source string, name string, bucket long, n long")
    got = quality.limits(sketch, ["lang"]).first()
    assert (got.texts, got.high) == (20, 9 + 3 * 20)  # quartiles 1 and 9, the least spread is larger


def test_outliers_of_a_group_go_and_others_stay(spark):
    rows = [row(k, prose(k, 60), "en", "tidy") for k in range(260)]
    rows += [row(1000 + k, " ".join(w + " #" for w in prose(k, 60).split()), "en", "marked") for k in range(260)]
    odd = " ".join(w + " #" for w in prose(5, 60).split())
    docs = spark.createDataFrame([*rows, row(5000, odd, "en", "tidy"), row(5001, "too short", "en", "tidy"), row(5002, "in " * 200, "en", "tidy")], SCHEMA)
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert not got[5000].kept and not got[5000].base_failed  # usual among "marked", odd among "tidy"
    assert got[5001].base_failed and got[5002].base_failed
    assert all(r.kept for k, r in got.items() if k < 5000)


def test_awkward_and_empty(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    got = quality.judged(docs).collect()
    assert len(got) == docs.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (2, 3, 4))
    assert [r.kept for r in got if r.doc_id == 7] == [True, True] and [r.kept for r in got if r.doc_id == 5] == [True]
    assert quality.judged(docs.filter("false")).count() == 0

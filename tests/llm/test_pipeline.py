"""The stages over the given tables: what each must drop and must keep."""

import re

import corpus_pipeline

from .test_near import shingles, similar
from .test_simhash import roots

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = (before, docs.collect())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = at["toxicity"]
    kept = {r.doc_id for r in after}
    gone = before.keys() - kept
    assert all(labels.get(k, 1) for k in gone), "a clean labelled document went"

    before, after = at["near_dedup"]
    sets = {k: shingles(r.text) for k, r in before.items()}
    pairs = [(a, b) for a in sets for b in sets if b < a and similar(sets[a], sets[b])]
    assert len(pairs) > 10 and {r.doc_id for r in after} == set(roots(list(sets), pairs).values())

    before, after = at["substring_dedup"]
    texts = [words(r.text) for r in sorted(after, key=lambda r: r.doc_id)]
    seen, twice = set(), 0
    for w in texts:
        mine = {tuple(w[k : k + 60]) for k in range(len(w) - 59)}
        twice += len(mine & seen)
        seen |= mine
    assert twice == 0
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = at["decontamination"]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows, short = set(), set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        if 0 < len(w) < 10:
            short.add(tuple(w))
    hit = {k for k, r in before.items() for w in [split(r.text)] if any(tuple(w[p : p + 10]) in windows for p in range(len(w) - 9))
           or any(tuple(w[p : p + len(s)]) == s for s in short for p in range(len(w)))}
    assert {r.doc_id for r in after} == before.keys() - hit

    before, after = at["mixing"]
    taken, size = {}, {}
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    for r in before.values():
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    longest = max(len(words(r.text)) for r in before.values())
    assert all(taken.get(s, 0) <= 2 * n + 2 * longest for s, n in size.items())
    assert all(r.copy in (1, 2) for r in after)


def test_run_and_entry(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    ours = [q for q in queries if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in ours) == list(range(1, 14))
    assert "pipeline" in queries and set(oracles) <= set(queries)
    assert corpus_pipeline.run(spark, SF).count() > 0

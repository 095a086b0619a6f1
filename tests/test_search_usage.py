"""Search, suggestions, usage, admission, streams."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from terrane.functions.text import call_status, client_label, fold, forwarded_address, shorten, tokens
from terrane.operators import search
from terrane.operators.search import build_index, closest_terms, corpus_statistics, ranked_hits, search_all_then_any, search_any, similar_terms
from terrane.operators.usage import Meter, admit, attribute_clients, trailing_load
from terrane.session import shared_dir
from terrane.sources.cubes import read_cube
from terrane.streaming.admission import ROCKSDB, admit_stream
from terrane.streaming.jobs import land_cubes, run_to_table

TITLES = [("wages_q", "Labour cost index (LCI) of services and industry by economic section", "eurostat"),
          ("ferry", "Passengers carried on ferry lines between islands, quarterly count per port", "eurostat"),
          ("theatre", "Théâtres", "osm")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(TITLES, "doc string, title string, source string")
    index = build_index(docs, "title")
    return docs, index, corpus_statistics(index, docs)


def found(corpus, spark, text):
    docs, index, stats = corpus
    asked = spark.createDataFrame([(1, text)], "query_id int, query string")
    return [(r.doc, r.partial) for r in search_all_then_any(asked, index, stats).orderBy("place").collect()]


def test_all_terms_with_plural(spark, corpus):
    assert found(corpus, spark, "labour cost index services") == [("wages_q", False)]


def test_any_term_fallback_is_partial(spark, corpus):
    assert found(corpus, spark, "LCI per hour")[0][1] is True
    assert ("wages_q", True) in found(corpus, spark, "LCI per hour")
    assert found(corpus, spark, '"') == [] and found(corpus, spark, "THÉÂTR") == [("theatre", False)]


def test_any_term_by_source_and_blank_query(spark, corpus):
    docs, index, stats = corpus
    asked = spark.createDataFrame([(1, "index theat"), (2, " ")], "query_id int, query string")
    got = {(r.query_id, r.doc) for r in search_any(asked, index, stats, docs, "osm").collect()}
    assert got == {(1, "theatre"), (2, "theatre")}
    assert search_any(asked.where("query_id = 2"), index, stats, docs).count() == 3


def test_spec_and_dataset_search(spark, specs, canonical):
    from terrane.plans.lookup import search_datasets, search_indicators
    from terrane.schemas import CATALOGUE

    asked = spark.createDataFrame([(1, "wage"), (2, "pharmacy dwelling pharmacies")], "query_id int, query string")
    got = {(r.query_id, r.id): r.materialized for r in search_indicators(asked, specs, canonical.where("indicator <> 'dwellings'")).collect()}
    assert got == {(1, "wage_index"): True, (2, "dwellings"): False, (2, "pharmacies"): True}
    assert {r.id for r in search_indicators(asked, specs, canonical, source="osm").collect()} == {"pharmacies"}
    catalogue = spark.createDataFrame([("wages_q", TITLES[0][1], "2000", "2024", "x"), ("ferry", TITLES[1][1], "1997-Q1", "2025-Q2", "x")], CATALOGUE)
    asked = spark.createDataFrame([(1, "labour cost index services"), (2, "LCI per hour"), (3, "ferry 1997")], "query_id int, query string")
    got = {(r.query_id, r.place): (r.code, r.partial, r.data_end) for r in search_datasets(asked, catalogue).collect()}
    assert got[1, 1] == ("wages_q", False, "2024") and got[2, 1][1] is True and got[3, 1] == ("ferry", False, "2025-Q2")


def test_folding(spark):
    rows = spark.createDataFrame([("Île-de-FRANCE Straße Ærø",)], "t string")
    assert rows.select(fold(F.col("t")).alias("f")).first().f == "ile-de-france strasse ærø"
    assert rows.select(tokens(F.col("t")).alias("w")).first().w == ["ile", "de", "france", "strasse", "ærø"]
    other = spark.createDataFrame([("Αθήνα Йошкар ＡＢＣ１",)], "t string")
    assert other.select(fold(F.col("t")).alias("f")).first().f == "αθηνα иошкар abc1"


def test_closest(spark):
    words = spark.createDataFrame([("hu23",), ("zzzzzz",)], "word string")
    vocabulary = spark.createDataFrame([("HU22",), ("HU10",), ("HU221",), ("CZ08",), ("HU2",)], "term string")
    got = [(r.word, r.term, round(r.ratio, 6)) for r in closest_terms(words, vocabulary).orderBy("place").collect()]
    # HU23 has five pairs of neighbours with its ends, three of them in common with HU22 of five, HU2 of four and HU221 of six
    assert got == [("HU23", "HU2", round(6 / 9, 6)), ("HU23", "HU22", 0.6), ("HU23", "HU221", round(6 / 11, 6))]


def test_closest_against_all_pairs(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))) for _ in range(120)] + ["gdp_per_capita", "aaaaaaaa"]
    asked = texts[:40] + ["gdp_per_inhabitant", "aaa", "b" * 10_000]

    def pairs(t):
        t = f"\2{t.upper()}\3"
        out = {}
        for k in range(len(t) - 1):
            out[t[k : k + 2]] = out.get(t[k : k + 2], 0) + 1
        return out

    def ratio(a, b):
        x, y = pairs(a), pairs(b)
        return 2 * sum(min(n, y.get(g, 0)) for g, n in x.items()) / (sum(x.values()) + sum(y.values()))

    for cutoff in ((1, 2), (4, 5)):
        want = {}
        for w in set(asked):
            best = sorted((-ratio(w, t), t.upper()) for t in set(texts) if ratio(w, t) * cutoff[1] >= cutoff[0] - 1e-12)[:3]
            want |= {(w.upper(), k): (t, round(-r, 9)) for k, (r, t) in enumerate(best, 1)}
        got = closest_terms(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(t,) for t in texts], "term string"), cutoff=cutoff)
        assert {(r.word, r.place): (r.term.upper(), round(r.ratio, 9)) for r in got.collect()} == want
    assert ("GDP_PER_INHABITANT", 1) not in want and closest_terms(
        spark.createDataFrame([("gdp_per_inhabitant",)], "word string"), spark.createDataFrame([(t,) for t in texts], "term string")).first().term == "gdp_per_capita"


def test_texts_with_little_in_common_form_no_rows(spark, monkeypatch):
    """Most words share some character pair with most terms: counted in blocks, such pairs are no rows of a join."""
    rnd = random.Random(8)
    texts = sorted({"".join(rnd.choice("ABCDEF") for _ in range(9)) for _ in range(500)})
    words, vocabulary = (spark.createDataFrame([(t,) for t in some], f"{name} string") for name, some in (("word", texts[::2]), ("term", texts[1::2])))

    def pairs(t):
        return Counter(a + b for a, b in pairwise(f"\2{t}\3"))

    want = {(w, t): 2 * c / 20 for w in texts[::2] for t in texts[1::2] if (c := (pairs(w) & pairs(t)).total()) >= 5}
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def largest(plan):
        own = plan.metrics().get("numOutputRows")
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return max([own.get().value() if own.isDefined() else 0, *map(largest, children)])

    def check():
        found = similar_terms(words, vocabulary)
        assert {(r.word, r.term): r.ratio for r in found.collect()} == want
        return largest(found._jdf.queryExecution().executedPlan())

    try:
        assert check() <= max(len(want), len(texts))  # there are 62,500 pairs
        monkeypatch.setattr(search, "BLOCK_TEXTS", 64)
        check()
        monkeypatch.setattr(search, "BLOCK_CHARS", 400)
        check()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_phrases(spark):
    """The parts of a word with other characters inside must stand side by side, in one column; the last one may go on."""
    docs = spark.createDataFrame([("a", "rail_12_freight", "x"), ("b", "rail freight 12", "x"), ("c", "rail", "12 freight"), ("d", "on rail 12 freighters rail 12 freight", "x")], "doc string, t string, u string")
    index = build_index(docs, "t", "u")
    stats = corpus_statistics(index, docs)

    def hits(text):
        return sorted(r.doc for r in search_all_then_any(spark.createDataFrame([(1, text)], "query_id int, query string"), index, stats).collect())

    assert hits("rail_12_fre") == ["a", "d"] and hits("rail-12") == ["a", "d"] and hits("rail 12 freight") == ["a", "b", "c", "d"]
    assert hits("rai_12") == [] and hits("12_freight rail") == ["a", "c", "d"] and hits('"rail"_') == ["a", "b", "c", "d"]
    found = {(r.doc, r.term): (r.tf, r.positions) for r in index.where("term in ('rail', '12')").collect()}
    assert found["d", "rail"] == (2, [1, 4]) and found["c", "12"] == (1, [2]) and found["a", "12"] == (1, [1])
    assert index.agg(F.sum("tf")).first()[0] == stats.first().mean_length * 4


def test_index_at_rest(spark):
    """Only what changed is taken apart; a run that broke off before the list of documents is made good by the next."""
    from terrane.sources.postings import read_index, refresh_index

    def docs(**texts):
        return spark.createDataFrame(sorted(texts.items()), "doc string, t string")

    def held():
        index, known = read_index(spark, root)
        return sorted((r.doc, r.term, r.tf, r.length) for r in index.collect()), sorted(r.doc for r in known.collect())

    def whole(**texts):
        return sorted((r.doc, r.term, r.tf, r.length) for r in build_index(docs(**texts), "t").collect()), sorted(texts)

    root = f"{shared_dir(spark, 'test')}/index"
    first = dict(a="alpha beta", b="beta beta gamma", c="delta", d="")
    assert refresh_index(docs(**first), root, "t")["new"] == 4 and held() == whole(**first)
    again = refresh_index(docs(**first), root, "t")
    assert (again["unchanged"], again["buckets"]) == (4, 0)
    second = dict(a="alpha beta", b="gamma epsilon", e="zeta alpha", d="delta")
    counts = refresh_index(docs(**second), root, "t")
    assert (counts["new"], counts["changed"], counts["gone"], counts["unchanged"]) == (1, 2, 1, 1) and held() == whole(**second)
    spark.createDataFrame([("a", 0), ("c", 0)], "doc string, digest long").write.mode("overwrite").parquet(f"{root}/documents")
    refresh_index(docs(**second), root, "t")
    assert held() == whole(**second)
    terms = spark.createDataFrame([("alpha",)], "q_term string")
    some = {r.term for r in read_index(spark, root, terms)[0].collect()}
    assert "alpha" in some and len(some) < 6


def test_call_log_rules(spark):
    replies = [("Erreur : quota journalier", "quota"), ("Erreur : trop d'appels", "burst"), ("Aucune valeur", "empty"), ("Erreur : x", "empty"), ("a | b", "ok")]
    rows = spark.createDataFrame(replies, "reply string, want string")
    assert all(r.s == r.want for r in rows.select("want", call_status(F.col("reply")).alias("s")).collect())
    one = spark.range(1)
    assert one.select(call_status(F.lit("x"), F.lit("KeyError")).alias("s")).first().s == "error:KeyError"
    assert one.select(shorten(F.lit("é" * 301)).alias("s")).first().s == "é" * 300 + "…"
    assert one.select(client_label(F.lit("ip"), F.lit("1.2.3.4")).alias("s")).first().s == "ip:6694f83c9f"


@pytest.mark.parametrize("chain, hops, want", [("1.1.1.1, 198.51.100.9", 1, "198.51.100.9"), ("1.1.1.1", 3, "1.1.1.1"), ("", 1, "9.9.9.9"), ("1.1.1.1", 0, "9.9.9.9")])
def test_forwarded(spark, chain, hops, want):
    assert spark.range(1).select(forwarded_address(F.lit("9.9.9.9"), F.lit(chain), hops).alias("a")).first().a == want


def test_attribution(spark):
    schema = "request_id int, ip string, forwarded string, headers map<string,string>, query string"
    rows = [(1, "8.8.8.8", None, {"x-api-key": "good"}, None), (2, "8.8.8.8", None, {"authorization": "Bearer bad"}, ""), (3, "10.1.7.255", None, {}, "b=1&key=good"),
            (4, "10.1.7.255", None, {}, None), (5, "10.1.8.0", None, {}, None), (6, "::1", None, {}, None), (7, "1.1.1.1", None, {"authorization": "bearer gold"}, None)]
    keys = spark.createDataFrame([("good", "pro"), ("gold", "platinum")], "key string, tier string")
    nets = spark.createDataFrame([("10.1.0.9/21",), ("bad",), ("7.7.7.7",)], "cidr string")
    got = {r.request_id: (r.kind, r.ident, r.tier) for r in attribute_clients(spark.createDataFrame(rows, schema), keys, nets).collect()}
    assert got == {1: ("key", "good", "pro"), 2: ("ip", "8.8.8.8", "badkey"), 3: ("key", "good", "pro"), 4: ("shared", "shared", "shared"),
                   5: ("ip", "10.1.8.0", "anon"), 6: ("ip", "::1", "anon"), 7: ("key", "gold", "free")}


START = datetime(2024, 1, 1, 23, 0)
CALL = "call_id int, at string, kind string, ident string, tier string, session string, weight int"


def calls(spark, rows):
    return spark.createDataFrame([(i, str(START + timedelta(seconds=s)), k, d, t, x, w) for i, (s, k, d, t, x, w) in enumerate(rows)], CALL).select(
        "call_id", F.col("at").cast("timestamp_ntz").alias("ts"), "kind", "ident", "tier", "session", "weight")


def verdicts(spark, rows, **how):
    return [r.verdict for r in admit(calls(spark, rows), **how).orderBy("call_id").collect()]


ANON = ("ip", "a", "anon", "")


@pytest.mark.parametrize("rows, how, want", [
    ([(61 * k, *ANON, 1) for k in range(4)], dict(limits={"anon": 3}), ["admitted"] * 3 + ["daily"]),
    ([(0, *ANON, 1), (3599, *ANON, 1), (3600, *ANON, 1)], dict(limits={"anon": 1}), ["admitted", "daily", "admitted"]),
    ([(t, *ANON, 1) for t in (0, 1, 2, 61)], dict(burst=2), ["admitted", "admitted", "burst", "admitted"]),
    ([(t, *ANON, 1) for t in (3559, 3570, 3600, 3619, 3630)], dict(burst=2), ["admitted", "admitted", "burst", "admitted", "admitted"]),
    ([(0, *ANON, 2), (70, *ANON, 2)], dict(limits={"anon": 3}), ["admitted", "daily"]),
    ([(0, "key", "p", "pro", "", 1)] * 50, dict(burst=1), ["admitted"] * 50),
    ([(0, "shared", "shared", "shared", s, 1) for s in "aba"], dict(burst=1), ["admitted", "admitted", "burst"]),
    ([(0, "shared", "shared", "shared", "", 1)] * 3, dict(burst=1), ["admitted"] * 3),
])
def test_admission_cases(spark, rows, how, want):
    assert verdicts(spark, rows, **how) == want


def crowd(n=1500):
    """Four clients, one of them with most calls; three days, several sessions."""
    rnd = random.Random(3)
    rows = []
    for _ in range(n):
        who = rnd.choice(["hot"] * 6 + ["a", "b", "shared"])
        kind, tier = ("shared", "shared") if who == "shared" else ("ip", "anon")
        rows.append((rnd.randrange(0, 3 * 86_400 if who != "hot" else 90_000), kind, who, tier, rnd.choice(["", "s1", "s2"]), rnd.choice([1, 1, 2])))
    return sorted(rows)


def sequential(rows, limits, burst, seconds=60):
    out, meters = [], {}
    for s, kind, who, _tier, session, w in rows:
        now = START + timedelta(seconds=s)
        day, m = meters.get(who, (None, Meter(burst, seconds)))
        if day != now.date():
            m.used = 0
        meters[who] = (now.date(), m)
        bucket = (f"shared:{session}" if session else None) if kind == "shared" else who
        out.append(m.decide(s, bucket, w, limits["shared" if kind == "shared" else "anon"]))
    return out


@pytest.mark.parametrize("limits, burst, seconds", [({"anon": 400, "shared": 90}, 2, 600), ({"anon": 40, "shared": 20}, 3, 3600), ({"anon": 7, "shared": 5}, 4, 60)])
def test_admission_equals_sequential(spark, limits, burst, seconds):
    rows = crowd()
    want = sequential(rows, limits, burst, seconds)
    assert verdicts(spark, rows, limits=limits, burst=burst, seconds=seconds) == want
    assert verdicts(spark, rows, limits=limits, burst=burst, seconds=seconds, ordered_rows=0) == want


def test_used_up_days_need_no_order(spark):
    """A busy client: most of its day lies behind the cut, and a call that still fits reopens the day."""
    from terrane.operators.usage import MICROS, _exhausted_after

    rows = [(3600 + 5 * k, "ip", "hot", "anon", "", 1 if k % 50 == 0 else 2) for k in range(2000)]
    how = dict(limits={"anon": 51}, burst=10, seconds=60)
    want = sequential(rows, how["limits"], 10)
    assert verdicts(spark, rows, ordered_rows=0, **how) == want
    even = [(t, k, w, x, s, 2) for t, k, w, x, s, _ in rows]
    assert verdicts(spark, even, ordered_rows=0, **how) == sequential(even, how["limits"], 10)
    shaped = calls(spark, even).select("call_id", F.lit("c").alias("client"), F.to_date("ts").alias("day"), (F.unix_date(F.to_date("ts")).cast("bigint") * 86_400 * MICROS + F.col("call_id").cast("bigint") * 5 * MICROS).alias("us"),
                                       F.lit("c").alias("bucket"), "weight", F.lit(51).alias("day_limit"), F.lit(False).alias("carried"))
    assert 0 < _exhausted_after(shaped, 10, 60 * MICROS).first().cut < 30


def test_stream_admission_over_several_batches(spark):
    rows, root = crowd(400), shared_dir(spark, "test")
    frame = calls(spark, rows)
    for k in range(3):
        part = frame.where((F.col("call_id") >= k * 150) & (F.col("call_id") < (k + 1) * 150))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    how = dict(limits={"anon": 40, "shared": 20}, burst=3, seconds=3600)
    run_to_table(admit_stream(stream, **how), f"{root}/out", f"{root}/checkpoint")
    spark.conf.set(key, before)
    got = [r.verdict for r in spark.read.parquet(f"{root}/out").orderBy("call_id").collect()]
    assert got == sequential(rows, how["limits"], 3, 3600)


def test_stream_admission_keeps_the_day_after_a_late_call(spark):
    """Two calls fill today; a late call of yesterday counts to yesterday; today stays full. Unlimited calls pass by."""
    day = 86_400
    rows = [(day, *ANON, 1), (day + 100, *ANON, 1), (100, *ANON, 1), (day + 200, *ANON, 1), (day + 300, *ANON, 1), (day, "key", "p", "pro", "", 1)]
    frame, root = calls(spark, rows), shared_dir(spark, "test")
    for low, high in ((0, 2), (2, 3), (3, 6)):
        frame.where((F.col("call_id") >= low) & (F.col("call_id") < high)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    run_to_table(admit_stream(stream, limits={"anon": 2}, burst=50), f"{root}/out", f"{root}/checkpoint")
    spark.conf.set(key, before)
    got = [r.verdict for r in spark.read.parquet(f"{root}/out").orderBy("call_id").collect()]
    assert got == ["admitted", "admitted", "admitted", "daily", "daily", "admitted"]


def test_landing_a_dataset_in_several_batches(spark):
    root = shared_dir(spark, "test")
    lines = [("freq,geo\\TIME_PERIOD\t2020",), ("A,AA\t1",)], [("freq,geo\\TIME_PERIOD\t2020",), ("A,BB\t2",)]
    for part in lines:
        spark.createDataFrame(part, "value string").coalesce(1).write.mode("append").text(f"{root}/in/dataset=d1")
    spark.createDataFrame(lines[0], "value string").coalesce(1).write.text(f"{root}/in/dataset=d2")
    land_cubes(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint", files_per_batch=1)
    read = lambda: sorted((r.dataset, r.dims["geo"], r.value) for r in read_cube(spark, f"{root}/store").collect())
    assert read() == [("d1", "AA", 1.0), ("d1", "BB", 2.0), ("d2", "AA", 1.0)]
    empty = spark.createDataFrame([lines[0][0], ("A,AA\t:",)], "value string").coalesce(1)
    empty.write.mode("overwrite").text(f"{root}/in/dataset=d2")
    land_cubes(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint")
    assert read() == [("d1", "AA", 1.0), ("d1", "BB", 2.0)]  # a dataset without values goes


def test_limit_alone_decides(spark):
    docs = spark.createDataFrame([(k, "same word") for k in range(60)], "doc int, text string").withColumn("source", F.lit("s"))
    index = build_index(docs, "text")
    asked = spark.createDataFrame([(1, "word")], "query_id int, query string")
    statistics = corpus_statistics(index, docs)
    assert search_all_then_any(asked, index, statistics, limit=60).count() == 60
    assert search_any(asked, index, statistics, docs, limit=55).count() == 55


def test_trailing_load_equals_counting(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(0, 400), "ip", rnd.choice("ab"), "anon", "", rnd.choice([1, 2])) for _ in range(200)] + [(60, "ip", "c", "anon", "", 1), (120, "ip", "c", "anon", "", 1)]
    got = {r.call_id: r.load for r in trailing_load(calls(spark, rows).withColumnRenamed("ident", "client")).collect()}
    for i, (t, _, who, *_rest, _w) in enumerate(rows):
        assert got[i] == sum(w for s, _, x, *_r, w in rows if x == who and t - 60 < s <= t)


def test_landing_twice_changes_nothing(spark):
    root = shared_dir(spark, "test")
    line = spark.createDataFrame([("freq,geo\\TIME_PERIOD\t2020",), ("A,FR\t1 p",)], "value string").coalesce(1)
    line.write.text(f"{root}/in/dataset=d1")
    seen = []
    for _ in range(2):
        land_cubes(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint", after=lambda cube: seen.append(cube.count()))
    assert seen == [1]
    line.withColumn("value", F.replace("value", F.lit("1 p"), F.lit("2"))).write.text(f"{root}/in/dataset=d2")
    land_cubes(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint")
    assert {(r.dataset, r.value, r.flag) for r in read_cube(spark, f"{root}/store").collect()} == {("d1", 1.0, "p"), ("d2", 2.0, "")}


def test_texts_are_cut_once(spark):
    """The plan of an index cuts each column once, and its postings equal those counted by hand."""
    rows = [(1, "Éa ßx éa", "b ea"), (2, "", None), (3, None, "x y-x"), (None, "x", ""), (3, "y", "")]
    docs = spark.createDataFrame(rows, "doc int, t string, u string")
    index = build_index(docs, "t", "u")
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    got = sorted((str(r.doc), r.term, r.tf, r.length, tuple(r.positions)) for r in index.collect())
    assert got == [("1", "b", 1, 5, (4,)), ("1", "ea", 3, 5, (0, 2, 5)), ("1", "ssx", 1, 5, (1,)), ("3", "x", 2, 3, (1, 3)), ("3", "y", 1, 1, (0,)),
                   ("3", "y", 1, 3, (2,)), ("None", "x", 1, 1, (0,))]


def test_scores_meet_by_document(spark):
    """Rows of hits and queries, many more than the hits, are summed up where they arise."""
    docs = spark.createDataFrame([(k, "same word " * (k % 3 + 1)) for k in range(40)], "doc int, text string")
    index = build_index(docs, "text")
    asked = spark.createDataFrame([(k, "word same" if k % 2 else "words") for k in range(30)], "query_id int, query string")
    hits = ranked_hits(asked, index, corpus_statistics(index, docs))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in "".join(line for line in plan.splitlines() if ", doc#" in line)
    assert {(r.query_id, r.doc): r.matched for r in hits.collect()} == {(q, d): 1 + q % 2 for q in range(30) for d in range(40)}


def _brute_scores(rows, queries):
    """`query_id, doc -> score, matched, terms` by definition; rows of one key are one document."""
    words = [(doc, text.split()) for doc, text in rows]
    mean = sum(len(w) for _, w in words) / len(words)
    length = {doc: len(w) for doc, w in words}
    terms = {q: {t[:-1] if len(t) > 3 and t.endswith("s") else t for t in text.split()} for q, text in queries}
    tfs = {}
    for term in {t for some in terms.values() for t in some}:
        parts = term.split("_")
        for doc in length:
            own = [w for d, w in words if d == doc]
            if len(parts) == 1:
                tf = sum(word.startswith(term) for w in own for word in w)
            else:
                tf = len({p for w in own for p in range(len(w) - len(parts) + 1) if w[p : p + len(parts) - 1] == parts[:-1] and w[p + len(parts) - 1].startswith(parts[-1])})
            if tf:
                tfs.setdefault(term, {})[doc] = tf
    found = {}
    for q, some in terms.items():
        for term in some & set(tfs):
            idf = math.log((len(rows) - len(tfs[term]) + 0.5) / (len(tfs[term]) + 0.5))
            for doc, tf in tfs[term].items():
                s = (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[doc] / mean))
                score, matched, _ = found.get((q, doc), (0, 0, 0))
                found[q, doc] = score + s, matched + 1, len(some)
    return found


@pytest.mark.parametrize("broadcast_rows, part_hits", [(20_000, 500_000), (20_000, 7), (3, 7)])
def test_scores_against_definition(spark, monkeypatch, broadcast_rows, part_hits):
    """Documents that come twice, one without a key, postings in any order, phrases, terms that begin many words."""
    monkeypatch.setattr(search, "BROADCAST_ROWS", broadcast_rows, raising=False)
    monkeypatch.setattr(search, "PART_HITS", part_hits)
    monkeypatch.setattr(search, "PACK_ROWS", part_hits, raising=False)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abs") for _ in range(rnd.randint(1, 4)))
    rows = [(k, " ".join(word() for _ in range(rnd.randint(1, 12)))) for k in range(30)]
    rows += [rows[3], rows[3], (None, "ab ab sab b"), (40, "only words that nobody asks")]
    queries = [(k, " ".join("_".join(word() for _ in range(rnd.choice((1, 1, 1, 2, 3)))) for _ in range(rnd.randint(1, 4)))) for k in range(25)]
    queries += [(50, "ab sab"), (51, "zzz a"), (52, "zzz"), (queries[0])]
    docs, asked = spark.createDataFrame(rows, "doc int, text string"), spark.createDataFrame(queries, "query_id int, query string")
    index = search.cut_lineage(build_index(docs, "text").repartition(5, "term"))
    statistics, want = corpus_statistics(index, docs), _brute_scores(rows, queries)
    got = {(r.query_id, r.doc): (round(r.score, 9), r.matched, r.terms) for r in ranked_hits(asked, index, statistics).collect()}
    assert got == {key: (round(score, 9), *rest) for key, (score, *rest) in want.items()} and (50, None) in got
    some = {(r.query_id, r.doc): r.matched for r in ranked_hits(asked, index, statistics, within=docs.where("doc < 9")).collect()}
    assert some == {key: matched for key, (_, matched, _) in want.items() if key[1] is not None and key[1] < 9}
    whole = {q for (q, d), (_, matched, terms) in want.items() if matched == terms and d is not None}
    want = {(q, d): (round(s, 9), q not in whole) for (q, d), (s, matched, terms) in want.items() if q not in whole or (d is not None and matched == terms)}
    got = {(r.query_id, r.doc): (round(r.score, 9), r.partial) for r in search_all_then_any(asked, index, statistics, 100).collect()}
    assert got == want and whole and len(whole) < 20


def test_hits_travel_as_one_row_for_each_document(spark, monkeypatch):
    """A document's hits are many more than documents: neither tables nor shuffles have a row for each."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k + j) % 30}" for j in range(20))) for k in range(40)], "doc int, text string")
    index = search.cut_lineage(build_index(docs, "text"))
    asked = spark.createDataFrame([(k, " ".join(f"w{(k + j) % 30}" for j in range(25))) for k in range(9)], "query_id int, query string")
    statistics, rows, keep = corpus_statistics(index, docs), [], search.cut_lineage
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def exchanged(plan):
        own = [v.value() for v in [plan.metrics().get("shuffleRecordsWritten").get()]] if plan.nodeName() == "Exchange" else []
        return sum([own, *(exchanged(plan.children().apply(i)) for i in range(plan.children().size()))], [])

    def kept(frame):
        out = keep(frame)
        rows.extend([out.count()] if "doc" in out.columns else [])
        return out

    monkeypatch.setattr(search, "cut_lineage", kept)
    try:
        found = ranked_hits(asked, index, statistics)
        assert found.count() == 360  # 20 hits or more of each document in each query
        found.collect()
        rows += exchanged(found._jdf.queryExecution().executedPlan())
        assert rows and max(rows) <= 40
        rows.clear()
        search_all_then_any(asked, index, statistics).collect()
        assert max(rows) <= 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)

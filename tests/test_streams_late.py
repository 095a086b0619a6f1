"""Late rows and order of arrival in streams, and what can't be read of cube files."""

import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.operators.usage import Meter, admit
from terrane.plans.cubes import sync_cubes
from terrane.schemas import STATE
from terrane.session import shared_dir
from terrane.sources.cubes import parse_wide_lines, read_cube, wide_problems
from terrane.streaming.admission import ROCKSDB, OrderedAdmission, admit_stream_in_order
from terrane.streaming.jobs import compact_counts, count_with_late, counted, rollup_of, run_to_table

START = datetime(2024, 3, 1)
CALLS = "call_id long, ts timestamp_ntz, kind string, ident string, tier string, session string, weight int"


def test_late_calls_are_counted_apart(spark):
    root = f"{shared_dir(spark, 'test')}/late"
    batches = [[("a", 0, 1), ("b", 5, 2)], [("a", 30, 4), ("a", 2, 8)], [("a", 1, 16), ("b", 29, 32)], [("a", 31, 64)]]  # client, hour, weight
    schema = "client string, ts timestamp_ntz, weight long"
    for k, batch in enumerate(batches):
        spark.createDataFrame([(c, START + timedelta(hours=h), w) for c, h, w in batch], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    how = ("1 day", ["client"], {"used": F.col("weight")}, f"{root}/out", f"{root}/checkpoint")
    count_with_late(stream, *how)

    def sums(late):
        return {(r.client, r.window_start.day): r.used for r in counted(spark, f"{root}/out", ["client"], ["used"], late).collect()}

    # the call of hour 2 comes with that of hour 30, so its day is still open then; that of hour 1 comes after it
    def check():
        assert sums(True) == {("a", 1): 16}
        assert sums(False) == {("a", 1): 9, ("b", 1): 2, ("a", 2): 68, ("b", 2): 32}
        assert sums(None) == {("a", 1): 25, ("b", 1): 2, ("a", 2): 68, ("b", 2): 32}

    check()
    assert compact_counts(spark, f"{root}/out", ["client"], ["used"]) == 4
    check()
    assert compact_counts(spark, f"{root}/out", ["client"], ["used"]) == 0
    spark.createDataFrame([("a", START, 128)], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    count_with_late(stream, *how)
    assert sums(True) == {("a", 1): 144} and sums(None)["a", 1] == 153


def test_exact_median_from_counts(spark):
    rnd = random.Random(3)
    rows = [(k % 3, rnd.randrange(20)) for k in range(500)]
    counts = spark.createDataFrame(rows, "tool int, ms int").groupBy("tool", "ms").agg(F.count(F.lit(1)).alias("calls")).withColumn("window_start", F.lit(START))
    for r in rollup_of(counts, ["tool"]).collect():
        own = sorted(ms for tool, ms in rows if tool == r.tool)
        assert (r.calls, r.total_ms, r.median_ms, r.max_ms) == (len(own), sum(own), own[(len(own) - 1) // 2], own[-1])


@pytest.mark.parametrize("disorder", [0, 40])
def test_admission_follows_the_time_of_the_calls(spark, disorder):
    """Several batches, shuffled within the delay, give the verdicts of the batch job; the state is emptied as time goes on."""
    rnd = random.Random(disorder)
    rows = [(k, START + timedelta(minutes=7 * k), "ip", rnd.choice("ab"), "anon", "", rnd.choice([1, 1, 2])) for k in range(300)]
    arrived = sorted(rows, key=lambda r: r[0] + rnd.uniform(0, disorder))
    root = shared_dir(spark, "test")
    for k in range(0, 300, 75):
        spark.createDataFrame(arrived[k : k + 75], CALLS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    ahead = (-1, START + timedelta(days=400), "key", "z", "pro", "", 1)
    spark.createDataFrame([ahead], CALLS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    how = dict(limits={"anon": 60}, burst=3, seconds=1800)
    try:
        stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        run_to_table(admit_stream_in_order(stream, "6 hours", **how), f"{root}/out", f"{root}/checkpoint")
    finally:
        spark.conf.set(key, before)
    got = {r.call_id: (r.client, r.verdict) for r in spark.read.parquet(f"{root}/out").where("call_id >= 0").collect()}
    want = {r.call_id: (r.client, r.verdict) for r in admit(spark.createDataFrame(rows, CALLS), **how).collect()}
    assert got == want and {v for _, v in got.values()} == {"admitted", "burst", "daily"}


class States:
    """A processor's states in memory; counts the rows that go to them."""

    def __init__(self):
        self.rows, self.timers, self.values = 0, set(), {}
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def state(self, name, *schemas):
        outer, kept = self, self.values.setdefault(name, {})

        class State:
            def exists(self):
                return bool(kept)

            def get(self):
                return kept.get(())

            def update(self, value):
                self.updateValue((), value)

            def getValue(self, key):
                return kept.get(key)

            def updateValue(self, key, value):
                outer.rows += 1
                kept[key] = value

            def removeKey(self, key):
                kept.pop(key, None)

            def clear(self):
                kept.clear()

            def put(self, rows):
                kept.clear()
                self.appendList(rows)

            def appendList(self, rows):
                outer.rows += len(rows)
                kept[()] = [*kept.get((), []), *rows]

        return State()

    getValueState = getListState = getMapState = state


class Watermark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def test_waiting_calls_are_packed():
    """Calls that wait go to the state by day, not one by one, and leave it as they become due, a part of a day too."""
    rnd = random.Random(9)
    day, start = 86_400_000_000, 19_783
    calls = pd.DataFrame([(start * day + rnd.randrange(3 * day) // 10_000 * 10_000, k, rnd.choice(["a", "b", None]), rnd.choice([1, 2])) for k in range(3000)], columns=["us", "call_id", "client", "weight"])
    calls = calls.assign(bucket=calls["client"], day_limit=300, day=(calls["us"] // day).map(lambda d: date(1970, 1, 1) + timedelta(days=d)))
    states, window = States(), 3_600_000_000
    job = OrderedAdmission(20, window)
    job.init(states)
    parts = [calls.iloc[k : k + 500] for k in range(0, 3000, 500)]
    for batch in (parts[:4], parts[4:]):
        assert not len(pd.concat(job.handleInputRows((1,), iter(batch), Watermark(0))))
    assert states.rows < 30 and states.timers == {int(calls["us"].min()) // 1000 + 1}
    got = {}
    for passed in (start * day + day // 3, start * day + 2 * day, (start + 4) * day):
        at, = states.timers
        states.timers.clear()
        assert at <= passed // 1000
        due = pd.concat(job.handleExpiredTimer((1,), Watermark(passed), None))
        assert set(due["call_id"]) == set(calls["call_id"][calls["us"] < passed]) - got.keys()
        got |= dict(zip(due["call_id"], due["verdict"], strict=True))
    assert not states.timers and not states.values["waiting"] and states.rows < 60
    want = {}
    for client in ("a", "b", None):
        own = calls[calls["client"].isna() if client is None else calls["client"] == client].sort_values(["us", "call_id"])
        meter, at = Meter(20, window), None
        for us, call_id, weight in zip(own["us"], own["call_id"], own["weight"], strict=True):
            if us // day != at:
                meter.used, at = 0, us // day
            want[call_id] = meter.decide(us, client, weight, 300)
    assert got == want and set(want.values()) == {"admitted", "burst", "daily"}


def test_problems_of_wide_files(spark):
    head = "freq,geo\\TIME_PERIOD\t2020\t2021"
    files = {"good": [head, "A,LV\t1\t: z", "A,EE\t\t2 p"], "bare": ["A,LV\t1\t2"], "twice": [head, "A,LV\t1\t2", head],
             "odd": [head, "A,LV\tn/a\t5", "A\t1\t2", "A,EE\t1\t2\t3", "A,LT\t2d\t4"]}
    lines = spark.createDataFrame([(f, f, x) for f, rows in files.items() for x in rows], "file string, dataset string, line string")
    landed = spark.createDataFrame([(f, f) for f in [*files, "empty"]], "dataset string, file string")
    got = sorted((r.dataset, r.reason, r.series, r.cell) for r in wide_problems(lines, landed, 5).na.fill("-").collect())
    assert got == [("bare", "no_header", "-", "-"), ("empty", "no_header", "-", "-"), ("odd", "cells", "A,EE", "-"), ("odd", "codes", "A", "-"),
                   ("odd", "number", "A,LT", "2d"), ("odd", "number", "A,LV", "n/a"), ("twice", "headers", "-", "-")]
    assert parse_wide_lines(lines.where("file = 'good'"), 1).count() == 2


def test_a_bad_file_keeps_its_rows_and_the_rest_goes_on(spark, tmp_path):
    head = "freq,geo\\TIME_PERIOD\t2020\t2021\n"
    landing, root = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()

    def land(**files):
        for name, text in files.items():
            (landing / f"{name}.tsv").write_text(text)

    def run(state, signal):
        remote = spark.createDataFrame([("a", signal), ("b", signal), ("c", signal)], "key string, signal string")
        outcomes, after = sync_cubes(spark, str(landing), root, remote, state, "cube", datetime(2025, 1, int(signal)), quarantine=str(tmp_path / "quarantine"))
        return {r.key: (r.status, r.reason, r.rows) for r in outcomes.collect()}, spark.createDataFrame(after.collect(), STATE)

    def bad():
        return {(r.dataset, r.reason) for r in spark.read.parquet(str(tmp_path / "quarantine")).collect()}

    land(a=head + "A,LV\t1\t2\n", b=head + "A,LV\t3\tx\n")
    got, state = run(spark.createDataFrame([], STATE), "1")
    assert got == {"a": ("updated", None, 2), "b": ("updated", None, 1), "c": ("failed", "no_file", 0)} and bad() == {("b", "number")}
    land(a="A,LV\t5\t6\n", b=head + "A,LV\t3\t4\n", c="")
    got, state = run(state, "2")
    assert got == {"a": ("failed", "bad_file", 0), "b": ("updated", None, 2), "c": ("failed", "no_file", 0)} and bad() == {("a", "no_header")}
    assert sorted((r.dataset, r.value) for r in read_cube(spark, root).collect()) == [("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)]
    assert {r.key: r.value for r in state.collect()} == {"a": "1", "b": "2"}
    land(a=head + "A,LV\t5\t6\n")
    assert run(state, "2")[0] == {"a": ("updated", None, 2), "b": ("unchanged", None, 0), "c": ("failed", "no_file", 0)}

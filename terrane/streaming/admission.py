"""Admission of calls as a stream: the same meter as in batch, kept as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import client_label
from ..operators.usage import BURST, BURST_SECONDS, MICROS, Meter, burst_bucket, daily_limit, instant, micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Days before a client's newest whose totals stay in the state.
DAYS_KEPT = 2
#: Groups of clients that share a state in `admit_stream_in_order`; fixed for the life of a checkpoint.
GROUPS = 256
#: Calls that are packed together at a time, and what is kept of each while it waits.
PART_CALLS = 100_000
WAITING = pa.schema([("us", pa.int64()), ("call_id", pa.int64()), ("client", pa.string()), ("bucket", pa.string()), ("weight", pa.int32()), ("day_limit", pa.int32())])
DAY = 86_400 * MICROS
OUTPUT = "call_id long, client string, verdict string"


class Admission(StatefulProcessor):
    """One client's meter. The calls of a micro-batch are taken in the order of `(us, call_id)`."""

    def __init__(self, burst: int, window: int):
        self.burst, self.window = burst, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day date", "used int")
        self.recent = handle.getListState("recent", "us long, bucket string, weight int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["us", "call_id"])
        meter = Meter(self.burst, self.window)
        if self.recent.exists():
            for us, bucket, weight in self.recent.get():
                meter.remember(us, bucket, weight)
        # a late call counts to its own day and leaves the other days as they are
        used = {day[0]: count[0] for day, count in self.days.iterator()} if self.days.exists() else {}
        verdicts = []
        for us, day, bucket, weight, limit in zip(
                calls["us"], calls["day"], calls["bucket"], calls["weight"], calls["day_limit"], strict=True):
            meter.used = used.get(day, 0)
            verdicts.append(meter.decide(int(us), bucket, int(weight), int(limit)))
            used[day] = meter.used
        for day, count in used.items():
            if (max(used) - day).days <= DAYS_KEPT:
                self.days.updateValue((day,), (int(count),))
            else:
                self.days.removeKey((day,))
        if meter.recent:
            self.recent.put([(int(u), b, int(w)) for u, b, w in meter.recent])
        else:
            self.recent.clear()
        yield pd.DataFrame({"call_id": calls["call_id"], "client": key[0], "verdict": verdicts})

    def close(self) -> None:
        pass


class OrderedAdmission(StatefulProcessor):
    """The meters of a group of clients over calls in the order of their time, whatever the order of arrival.

    Calls wait in the state, by day and packed as Arrow tables, until the watermark has passed them; a timer at the earliest one
    waiting wakes the group, which then takes the days that are due one by one, their calls in the order of `(us, call_id)`. So the
    state holds what lies within the delay, and the meters that a later call may still ask; a task holds a group's day.
    """

    def __init__(self, burst: int, window: int):
        self.burst, self.window = burst, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long, part int", "calls binary")
        # when the timer rings; of each day that waits: its number, its parts, its earliest call
        self.index = handle.getValueState("index", "at long, days string")
        # client, day, weight of the day, calls of the last window
        self.meters = handle.getValueState("meters", "meters string")

    def _index(self) -> tuple[int | None, dict[int, tuple[int, int]]]:
        at, days = self.index.get() or (None, "[]")
        return at, {day: (parts, first) for day, parts, first in json.loads(days)}

    def _wake(self, known: int | None, days: dict[int, tuple[int, int]]) -> None:
        """Remember what waits, with one timer at the earliest call; `known` is when it would ring so far."""
        if not days:
            self.index.clear()
            return
        at = min(first for _, first in days.values()) // 1000 + 1
        if at != known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at)
        self.index.update((at, json.dumps([(day, *of) for day, of in days.items()])))

    def _wait(self, days: dict[int, tuple[int, int]], calls: pa.Table) -> None:
        calls = calls.sort_by("us")
        us = calls["us"].to_numpy()
        starts = np.flatnonzero(np.diff(us // DAY, prepend=us[0] // DAY - 1))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(us)], strict=True):
            day, earliest = int(us[low]) // DAY, int(us[low])
            parts, first = days.get(day, (0, earliest))
            self.waiting.updateValue((day, parts), (_packed(calls.slice(low, high - low)),))
            days[day] = (parts + 1, min(first, earliest))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, days = self._index()
        held: list[pa.Table] = []
        for part in rows:  # PART_CALLS at a time: a group's batch is never held as a whole
            held.append(pa.Table.from_pandas(part[WAITING.names], WAITING, preserve_index=False))
            if sum(map(len, held)) >= PART_CALLS:
                self._wait(days, pa.concat_tables(held))
                held = []
        if held:
            self._wait(days, pa.concat_tables(held))
        self._wake(at, days)
        yield pd.DataFrame({"call_id": [], "client": [], "verdict": []}).astype({"call_id": "int64", "client": "str", "verdict": "str"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        _, days = self._index()
        meters: dict[str | None, list] = {}  # client: meter, day
        for client, day, used, recent in json.loads((self.meters.get() or ("[]",))[0]):
            meters[client] = [Meter(self.burst, self.window), day]
            meters[client][0].used = used
            for us, bucket, weight in recent:
                meters[client][0].remember(us, bucket, weight)
        for day in sorted(d for d, (_, first) in days.items() if first < passed):
            parts, _ = days.pop(day)
            calls = pa.concat_tables([_unpacked(self.waiting.getValue((day, part))[0]) for part in range(parts)])
            for part in range(parts):
                self.waiting.removeKey((day, part))
            due = pc.less(calls["us"], passed)
            left = calls.filter(pc.invert(due))
            if len(left):
                self._wait(days, left)
            yield self._decided(meters, day, calls.filter(due))
        self._wake(None, days)
        kept = []
        for client, (meter, day) in meters.items():  # a call still to come is not before `passed`
            recent = [r for r in meter.recent if r[0] > passed - self.window]
            if day >= passed // DAY or recent:
                kept.append((client, day, meter.used, recent))
        self.meters.update((json.dumps(kept),))

    def _decided(self, meters: dict[str | None, list], day: int, calls: pa.Table) -> pd.DataFrame:
        """Verdicts of calls of one day."""
        order = ("us", "call_id", "bucket", "weight", "day_limit")
        calls = calls.take(pc.sort_indices(calls, [(c, "ascending") for c in order], null_placement="at_start")).combine_chunks()
        coded = calls["client"].combine_chunks().dictionary_encode("encode")
        own = []
        for client in coded.dictionary.to_pylist():
            entry = meters.setdefault(client, [Meter(self.burst, self.window), day])
            if entry[1] != day:
                entry[0].used, entry[1] = 0, day
            own.append(entry[0])
        columns = [calls[c].to_pylist() for c in ("us", "bucket", "weight", "day_limit")]
        verdicts = [own[c].decide(*call) for c, *call in zip(coded.indices.to_pylist(), *columns, strict=True)]
        return pa.table({"call_id": calls["call_id"], "client": calls["client"], "verdict": verdicts}).to_pandas()

    def close(self) -> None:
        pass


def _packed(calls: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(calls)
    return sink.getvalue().to_pybytes()


def _unpacked(calls: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(calls)).read_all()


def _metered(calls: DataFrame, limits: dict[str, int] | None) -> DataFrame:
    label = client_label(F.col("kind"), F.col("ident"))
    return calls.select(
        "call_id", label.alias("client"), F.to_date("ts").alias("day"), micros(F.col("ts")).alias("us"),
        burst_bucket(F.col("kind"), F.col("tier"), F.col("session"), label).alias("bucket"),
        F.col("weight").cast("int").alias("weight"), daily_limit(F.col("tier"), limits).alias("day_limit"), instant(F.col("ts")).alias("at"))


def admit_stream_in_order(calls: DataFrame, delay: str, limits: dict[str, int] | None = None, burst: int = BURST,
                          seconds: int = BURST_SECONDS) -> DataFrame:
    """`call_id, client, verdict` as `operators.usage.admit` gives them, however the calls arrive within `delay`.

    For accounting, where a verdict may wait: a call is decided once no earlier one is expected, that is when the newest call is
    `delay` ahead of it. Calls that come later than that are left to `jobs.count_with_late`. Needs the RocksDB state store.
    Clients share states in groups, since a state of its own costs more than the few calls that most clients make.
    """
    read = _metered(calls, limits).withWatermark("at", delay)
    group = F.pmod(F.xxhash64("client"), F.lit(GROUPS)).cast("int")
    limited = read.where("day_limit is not null").select(group.alias("part"), *WAITING.names, "at").groupBy("part").transformWithStateInPandas(
        OrderedAdmission(burst, seconds * MICROS), OUTPUT, "append", "eventTime")
    return limited.unionByName(read.where("day_limit is null").select("call_id", "client", F.lit("admitted").alias("verdict")))


def admit_stream(calls: DataFrame, limits: dict[str, int] | None = None, burst: int = BURST,
                 seconds: int = BURST_SECONDS) -> DataFrame:
    """`call_id, client, verdict` as calls arrive; needs the RocksDB state store.

    Calls: `call_id, ts, kind, ident, tier, session, weight`. A refusal has to
    be told at once, so calls are not held back for the watermark: across
    micro-batches the order is that of arrival.
    """
    read = _metered(calls, limits).drop("at")
    limited = read.where("day_limit is not null").groupBy("client").transformWithStateInPandas(
        Admission(burst, seconds * MICROS), OUTPUT, "append", "none")
    # calls without a limit need no state
    return limited.unionByName(read.where("day_limit is null").select("call_id", "client", F.lit("admitted").alias("verdict")))

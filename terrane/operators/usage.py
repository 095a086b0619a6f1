"""Who calls, how much, and which calls are admitted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import client_label, forwarded_address
from ..session import cut_lineage

# Weights, tiers and default limits of calls.
WEIGHTS = {"get_indicators": 2, "query_data": 2}
TIERS = ("free", "pro")
DAILY_LIMITS = {"free": 500, "shared": 5000, "anon": 100}
BURST = 30
BURST_SECONDS = 60

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less UTC time, whatever the session zone."""
    ts = ts.cast("timestamp_ntz")
    whole = F.unix_date(F.to_date(ts)).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * MICROS + (F.extract(F.lit("SECOND"), ts) * MICROS).cast("bigint")


def instant(ts: Column) -> Column:
    """Timestamp of a zone-less UTC time, whatever the session zone."""
    return F.timestamp_micros(micros(ts))


def naive(ts: Column) -> Column:
    """Zone-less UTC time of a timestamp, whatever the session zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def call_weight(tool: Column, weights: dict[str, int] | None = None) -> Column:
    out = F.lit(1)
    for name, weight in (weights or WEIGHTS).items():
        out = F.when(tool == name, weight).otherwise(out)
    return out


def daily_limit(tier: Column, limits: dict[str, int] | None = None) -> Column:
    """Calls a day by tier; null is unlimited."""
    known = {**DAILY_LIMITS, **(limits or {})}
    return (
        F.when(tier == "pro", F.lit(None).cast("int")).when(tier == "free", known["free"])
        .when(tier == "shared", known["shared"]).otherwise(known["anon"])
    )


def ipv4(text: Column) -> Column:
    """Address as a number; null for anything else."""
    parts = F.split(text, r"\.")
    valid = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.try_cast("bigint"))
    fits = F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(valid, F.when(fits, number))


def network_key(address: Column, length: Column) -> Column:
    """Address with its host bits cleared."""
    size = F.pow(F.lit(2.0), (32 - length).cast("double")).cast("bigint")
    return address - F.pmod(address, size)


def shared_addresses(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Distinct `ip` that lie in one of the networks (`cidr`).

    A range test becomes an equality: for each prefix length in use the masked
    address is looked up. At most 33 lengths exist.
    """
    size = F.coalesce(F.split_part("cidr", F.lit("/"), F.lit(2)).try_cast("int"), F.lit(32))
    nets = networks.select(ipv4(F.split_part(F.trim("cidr"), F.lit("/"), F.lit(1))).alias("base"), size.alias("length")).where(
        F.col("base").isNotNull() & F.col("length").between(0, 32)).select(
        "length", network_key(F.col("base"), F.col("length")).alias("network")).distinct()
    lengths = nets.select(F.collect_set("length")).scalar()
    masked = addresses.select("ip").distinct().withColumn("address", ipv4(F.col("ip"))).where("address is not null").select(
        "ip", "address", F.explode(lengths).alias("length"))
    return masked.withColumn("network", network_key(F.col("address"), F.col("length"))).join(
        nets, ["length", "network"], "left_semi").select("ip").distinct()


def attribute_clients(requests: DataFrame, keys: DataFrame, networks: DataFrame, hops: int = 0,
                      key_header: str = "x-api-key") -> DataFrame:
    """`kind, ident, tier` per request: a known key, a shared network, else the address.

    `requests`: `request_id, ip, forwarded, headers, query`. An unknown key
    falls back to the address with tier `badkey`.
    """
    header = F.nullif(F.col("headers")[key_header], F.lit(""))
    auth = F.col("headers")["authorization"]
    bearer = F.when(F.lower(auth).startswith("bearer "), F.nullif(F.trim(F.substr(auth, F.lit(8))), F.lit("")))
    raw = F.regexp_extract(F.coalesce("query", F.lit("")), r"(?:^|&)key=([^&]+)", 1)
    from_query = F.nullif(F.try_url_decode(raw), F.lit(""))
    read = requests.select(
        "request_id", forwarded_address(F.col("ip"), F.col("forwarded"), hops).alias("ip"),
        F.coalesce(header, bearer, from_query).alias("key"))
    tiers = keys.groupBy("key").agg(F.max(F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("free")).alias("key_tier"))
    shared = shared_addresses(read, networks).withColumn("is_shared", F.lit(True))
    # most requests carry no key: each of them looks for a key of its own that nobody has, so they don't meet in one task
    spread = read.withColumn("_key", F.coalesce("key", F.concat(F.lit("\x00"), F.pmod(F.xxhash64("request_id"), F.lit(4096)))))
    joined = spread.join(tiers.withColumnRenamed("key", "_key"), "_key", "left").join(shared, "ip", "left")
    by_key = F.col("key_tier").isNotNull()
    in_net = F.coalesce("is_shared", F.lit(False))
    return joined.select(
        "request_id",
        F.when(by_key, "key").when(in_net, "shared").otherwise("ip").alias("kind"),
        F.when(by_key, F.col("key")).when(in_net, F.lit("shared")).otherwise(F.col("ip")).alias("ident"),
        F.when(by_key, F.col("key_tier")).when(in_net, "shared").when(F.col("key").isNotNull(), "badkey").otherwise("anon").alias("tier"),
    )


def daily_usage(calls: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Weight per UTC day and client against the tier's limit."""
    per_tier = calls.groupBy(F.to_date("ts").alias("day"), "client", "tier").agg(F.sum("weight").alias("used"))
    per_day = per_tier.groupBy("day", "client").agg(F.sum("used").alias("used"), F.max("tier").alias("tier"))
    limit = daily_limit(F.col("tier"), limits)
    return per_day.select("day", "client", "tier", "used", limit.alias("limit"),
                          F.coalesce(F.col("used") > limit, F.lit(False)).alias("over"))


def trailing_load(calls: DataFrame, seconds: int = BURST_SECONDS) -> DataFrame:
    """`load`: weight of the client's calls in the trailing window, the call included.

    Each call also goes, as context, to the next time slice of the window's
    length. A window frame then never leaves its (client, slice) group, so a
    busy client is spread over as many tasks as it has slices.
    """
    span = seconds * MICROS
    at = micros(F.col("ts"))
    slice_of = F.floor(at / span)
    sliced = calls.select("*", at.alias("_us"), F.explode(F.array(slice_of, slice_of + 1)).alias("_slice"))
    frame = Window.partitionBy("client", "_slice").orderBy("_us").rangeBetween(-(span - 1), 0)
    own = F.floor(F.col("_us") / span) == F.col("_slice")
    return sliced.withColumn("load", F.sum("weight").over(frame)).where(own).drop("_us", "_slice")


# ------------------------------------------------------------------ admission

class Meter:
    """Admitted calls of one client: weight of the day and the last minute per burst bucket."""

    def __init__(self, burst: int, window: int):
        self.burst, self.window = burst, window
        self.used = 0
        self.recent: deque = deque()  # (micros, bucket, weight)
        self.load: dict[str, int] = {}

    def expire(self, now: int) -> None:
        while self.recent and self.recent[0][0] <= now - self.window:
            _, bucket, weight = self.recent.popleft()
            left = self.load[bucket] - weight
            if left:
                self.load[bucket] = left
            else:
                del self.load[bucket]

    def remember(self, now: int, bucket: str | None, weight: int) -> None:
        if bucket:
            self.recent.append((now, bucket, weight))
            self.load[bucket] = self.load.get(bucket, 0) + weight

    def decide(self, now: int, bucket: str | None, weight: int, limit: int) -> str:
        self.expire(now)
        if bucket and self.load.get(bucket, 0) + weight > self.burst:
            return "burst"
        if self.used + weight > limit:
            return "daily"
        self.used += weight
        self.remember(now, bucket, weight)
        return "admitted"


def burst_bucket(kind: Column, tier: Column, session: Column, label: Column) -> Column:
    """Key of the one-minute window: none for `pro` and for shared calls without a session."""
    session = F.nullif(session, F.lit(""))
    return F.when(tier == "pro", F.lit(None).cast("string")).when(kind == "shared", F.concat(F.lit("shared:"), session)).otherwise(label)


def _fold(rows: DataFrame, burst: int, window: int) -> DataFrame:
    """Verdicts of `client, day` groups in order; the batches of a group stream through one meter.

    Memory is bounded by the calls a client may have admitted, not by the
    size of its group.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, meter = None, None
        for pdf in batches:
            out = []
            for client, day, us, bucket, weight, limit, carried in zip(
                    pdf["client"], pdf["day"], pdf["us"], pdf["bucket"], pdf["weight"], pdf["day_limit"],
                    pdf["carried"], strict=True):
                if (client, day) != current:
                    current, meter = (client, day), Meter(burst, window)
                if carried:
                    meter.remember(us, bucket, weight)
                    out.append(None)
                else:
                    out.append(meter.decide(us, bucket, weight, limit))
            pdf["verdict"] = out
            yield pdf.loc[~pdf["carried"], [*fields, "verdict"]]

    fields = [c for c in rows.columns if c != "carried"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "carried")
    ordered = rows.repartition("client", "day").sortWithinPartitions("client", "day", "us", "call_id")
    return ordered.mapInPandas(run, f"{schema}, verdict string")


def _slice(window: int) -> Column:
    """Number of the window-long slice of the day; carried calls have negative ones."""
    return F.floor((F.col("us") - F.unix_date("day").cast("bigint") * 86_400 * MICROS) / window)


def _exhausted_after(rows: DataFrame, burst: int, window: int) -> DataFrame:
    """`client, day, cut`: the slice by whose end the day's limit must be used up.

    A burst refusal of weight w proves that more than `burst - w` was admitted
    in this slice and the one before; without refusal all of the slice was. Two
    neighbours count half each. Sums per slice, so a busy client shrinks to at
    most one row per slice and bucket.
    """
    per_bucket = rows.where("not carried").groupBy("client", "day", "bucket", _slice(window).alias("slice")).agg(
        F.sum("weight").alias("asked"), F.max("weight").alias("largest"), F.max("day_limit").alias("day_limit"))
    proven = F.greatest(F.least(F.col("asked"), burst - F.col("largest") + 1), F.lit(0)) / 2
    gain = F.when(F.col("bucket").isNull(), F.col("asked")).when(F.col("slice") > 0, proven).otherwise(0)
    per_slice = per_bucket.groupBy("client", "day", "slice").agg(F.sum(gain).alias("gain"), F.max("day_limit").alias("day_limit"))
    so_far = F.sum("gain").over(Window.partitionBy("client", "day").orderBy("slice"))
    return per_slice.withColumn("so_far", so_far).where("so_far >= day_limit").groupBy("client", "day").agg(F.min("slice").alias("cut"))


def _decide(rows: DataFrame, burst: int, window: int, ordered_rows: int) -> DataFrame:
    """Verdicts of `client, day` groups that may hold carried calls.

    Groups of up to `ordered_rows` calls are simply taken in order. For larger
    ones only the part before the day is used up needs the order. After it
    nothing is admitted any more, so every later call is judged by itself
    against the state reached. Should one still fit, its group is taken in
    order as a whole.
    """
    largest = rows.groupBy("client", "day").count().agg(F.max("count")).first()[0] or 0
    if largest <= ordered_rows:
        return cut_lineage(_fold(rows, burst, window))
    cuts = cut_lineage(_exhausted_after(rows, burst, window))
    placed = rows.join(cuts, ["client", "day"], "left").withColumn("slice", _slice(window))
    late = F.coalesce(F.col("slice") > F.col("cut"), F.lit(False))
    head = cut_lineage(_fold(placed.where(~late).select(*rows.columns), burst, window))
    admitted = head.where("verdict = 'admitted'").join(cuts, ["client", "day"])
    # What is still in the window later lies in the last slice of the head; bounded by the day's limit.
    live = F.when((_slice(window) == F.col("cut")) & F.col("bucket").isNotNull(), F.struct("us", "bucket", "weight"))
    reached = admitted.groupBy("client", "day").agg(F.sum("weight").alias("used"), F.collect_list(live).alias("live"))
    judged = placed.where(late).select(*rows.columns).drop("carried").join(reached, ["client", "day"], "left")
    load = F.aggregate(
        F.filter("live", lambda e: (e["us"] > F.col("us") - window) & (e["bucket"] == F.col("bucket"))),
        F.lit(0), lambda acc, e: acc + e["weight"])
    verdict = F.when(F.col("bucket").isNotNull() & (F.coalesce(load, F.lit(0)) + F.col("weight") > burst), "burst").when(
        F.coalesce("used", F.lit(0)) + F.col("weight") > F.col("day_limit"), "daily")
    tail = cut_lineage(judged.select(*[c for c in head.columns if c != "verdict"], verdict.alias("verdict")))
    both = head.unionByName(tail)
    still_open = cut_lineage(tail.where("verdict is null").select("client", "day").distinct())
    if still_open.isEmpty():
        return both
    again = cut_lineage(_fold(rows.join(still_open, ["client", "day"], "left_semi").select(*rows.columns), burst, window))
    return both.join(still_open, ["client", "day"], "left_anti").select(*again.columns).unionByName(again)


def admit(calls: DataFrame, limits: dict[str, int] | None = None, burst: int = BURST,
          seconds: int = BURST_SECONDS, ordered_rows: int = 100_000) -> DataFrame:
    """`call_id, client, verdict` per call: admitted, or refused by `burst` or `daily`.

    `calls`: `call_id, ts, kind, ident, tier, session, weight`, taken in the
    order of `(ts, call_id)`. Refused calls use up nothing.

    Unlimited clients need no state and no shuffle. The others are cut at
    midnight, where the day's total restarts. What crosses midnight is the last
    minute's admitted calls: every day is first decided without it, then the
    days whose carried calls changed are decided again until none changes.
    """
    window = seconds * MICROS
    label = client_label(F.col("kind"), F.col("ident"))
    read = calls.select(
        "call_id", label.alias("client"), F.to_date("ts").alias("day"), micros(F.col("ts")).alias("us"),
        burst_bucket(F.col("kind"), F.col("tier"), F.col("session"), label).alias("bucket"),
        F.col("weight").cast("int").alias("weight"), daily_limit(F.col("tier"), limits).alias("day_limit"), "tier")
    free = read.where("tier = 'pro'").select("call_id", "client", F.lit("admitted").alias("verdict"))
    limited = cut_lineage(read.where("tier is null or tier <> 'pro'").drop("tier"))

    day_end = (F.unix_date("day") + 1).cast("bigint") * 86_400 * MICROS

    def carried_from(decided: DataFrame) -> DataFrame:
        tail = decided.where((F.col("verdict") == "admitted") & F.col("bucket").isNotNull()
                             & (F.col("us") > day_end - window))
        return cut_lineage(tail.select("call_id", "client", F.date_add("day", 1).alias("day"), "us", "bucket",
                                       "weight", "day_limit"))

    def moved(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.exceptAll(b).unionByName(b.exceptAll(a)).select("client", "day").distinct()

    decided = _decide(limited.withColumn("carried", F.lit(False)), burst, window, ordered_rows)
    known = limited.limit(0)
    while True:
        carried = carried_from(decided)
        # A carried call matters only to a day that has calls.
        touched = cut_lineage(moved(carried, known).join(limited.select("client", "day").distinct(), ["client", "day"], "left_semi"))
        if touched.isEmpty():
            break
        again = limited.join(touched, ["client", "day"], "left_semi").withColumn("carried", F.lit(False)).unionByName(
            carried.join(touched, ["client", "day"], "left_semi").withColumn("carried", F.lit(True)))
        kept = decided.join(touched, ["client", "day"], "left_anti")
        decided = cut_lineage(kept.unionByName(_decide(again, burst, window, ordered_rows).select(*kept.columns)))
        known = carried
    return free.unionByName(decided.select("call_id", "client", "verdict"))

"""Hard negatives by zone maps over blocks of vectors that stand along a Hilbert curve.

Vectors become integers, get the place of their cell on a Hilbert curve and are written as Parquet blocks in that order,
so a block holds near vectors. A block's zone map has the least and the greatest value of each dimension and its labels.
For an anchor, interval arithmetic over a zone map bounds the scores of all rows of the block from both sides, and only
blocks whose bounds meet a window of scores that the anchor still needs are read. Anchors are taken in groups, blocks in
buckets; a group meets the zone maps, or the blocks, of a bucket in one task, and keeps the best rows of each window
there, so what is handed on is a few rows for each anchor, window and bucket.

Three searches: blocks of the highest upper bounds give each anchor a floor for its last positive; blocks that can
beat the floor give the positives; blocks that meet a positive's window give its negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from .tokens import in_arrow

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this share of the positive's score, and no more than it.
SHARE = (4, 5)
#: Steps of a unit: a component x becomes floor(UNIT * x).
UNIT = 256
#: Components are held within this many steps, so that sums of products of some thousand dimensions fit 64 bits.
LIMIT = 1 << 23
#: Bits of a dimension that the place on the curve goes by.
BITS = 2
BLOCK_ROWS, BUCKET_BLOCKS = 512, 64
#: Anchors that are searched for together, and groups that share a copy of a bucket in one task.
GROUP, GROUPS = 64, 256
#: Buckets whose zone maps one task holds.
ZONE_BUCKETS = 256
#: Stands for a missing id, after all others; not for use as an id.
NO_ID = np.iinfo(np.int64).max
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def curve(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of (rows, dimensions) cells below 2^bits, as bytes that sort like the places.

    The axes are turned in place after J. Skilling, Programming the Hilbert curve (2004), for all rows at once.
    """
    x = cells.astype(np.uint32).T.copy()
    for level in range(bits - 1, 0, -1):
        q = np.uint32(1 << level)
        low = q - np.uint32(1)
        for axis in x:
            turned = (axis & q) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
    for before, axis in zip(x[:-1], x[1:], strict=True):
        axis ^= before
    flip = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    levels = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels).T.astype(np.uint8), axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point if all sums fit its 53 bits."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score (anchors, blocks) of any vector between `low` and `high` (blocks, dimensions)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def steps(column: pa.Array, width: int, unit: int = UNIT) -> np.ndarray:
    """(rows, width) integers of a list column; a shorter vector is filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = np.clip(np.floor(unit * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -LIMIT, LIMIT)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.astype(np.int64)
    return out


def usable(rows: DataFrame) -> DataFrame:
    """Rows of (id, label, vector, anchor) with a label and a vector whose components are all finite."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def _extent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component of each dimension; two numbers for each dimension reach the driver."""
    found = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    width = max([0, *(r["at"] for r in found)]) + 1
    low, high = np.zeros(width), np.zeros(width)
    for r in found:
        low[r["at"]], high[r["at"]] = r["low"], r["high"]
    return low, high


_PACKED = T.StructType([T.StructField(n, t) for n, t in (
    ("bucket", T.LongType()), ("block", T.LongType()), ("ids", T.BinaryType()), ("labels", T.BinaryType()), ("vectors", T.BinaryType()),
    ("low", T.BinaryType()), ("high", T.BinaryType()), ("anchors", T.BinaryType()))])


def blocks(rows: DataFrame, unit: int = UNIT, block_rows: int = BLOCK_ROWS, bucket_blocks: int = BUCKET_BLOCKS) -> tuple[DataFrame, int]:
    """The blocks of usable (id, label, vector, anchor), each with its zone map, and the number of dimensions."""
    low, high = _extent(rows)
    width, span = len(low), np.where(high > low, high - low, 1)
    kept = T.StructType([*[T.StructField(n, T.LongType()) for n in ("id", "label")], T.StructField("anchor", T.BooleanType()),
                         T.StructField("place", T.BinaryType()), T.StructField("body", T.BinaryType())])

    def placed(batches):
        for batch in batches:
            vectors = steps(batch.column(2), width, unit)
            cells = np.clip(((vectors / unit - low) / span * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            place = curve(cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([r.tobytes() for r in place], pa.binary()),
                                              pa.array([r.tobytes() for r in vectors.astype(np.int32)], pa.binary())], kept.names)

    narrow = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(int(NO_ID))).alias("id"), F.col("label").cast("long").alias("label"), "vector",
                         F.coalesce("anchor", F.lit(False)).alias("anchor"))
    sorted_rows = narrow.transform(in_arrow, placed, kept).repartitionByRange("place", "id").sortWithinPartitions("place", "id")

    def pack(batches):
        part, made, held = TaskContext.get().partitionId(), 0, None

        def block(table):
            vectors = np.frombuffer(b"".join(table.column("body").to_pylist()), np.int32).reshape(-1, width)
            number = (part << 32) + made
            return pa.RecordBatch.from_pylist([{
                "bucket": (part << 32) + made // bucket_blocks, "block": number, "ids": table.column("id").to_numpy().tobytes(),
                "labels": table.column("label").to_numpy().tobytes(), "vectors": vectors.tobytes(), "low": vectors.min(0).tobytes(),
                "high": vectors.max(0).tobytes(), "anchors": table.column("anchor").to_numpy(zero_copy_only=False).tobytes()}], arrow)

        arrow = pa.schema([(n, pa.int64() if k < 2 else pa.binary()) for k, n in enumerate(_PACKED.names)])
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            while held.num_rows >= block_rows:
                yield block(held.slice(0, block_rows).combine_chunks())
                held, made = held.slice(block_rows), made + 1
        if held is not None and held.num_rows:
            yield block(held.combine_chunks())

    return cut_lineage(sorted_rows.transform(in_arrow, pack, _PACKED)), width


def _longs(data: bytes, width: int = 1) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, width)


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, width).astype(np.int64)


_GROUP = "group long, ids binary, labels binary, vectors binary, least binary, most binary"


def anchor_groups(packed: DataFrame, width: int, size: int = GROUP) -> DataFrame:
    """The anchors of the blocks, `size` neighbours on the curve to a row, with one window that is open on both sides."""

    def run(batches):
        part, made, held = TaskContext.get().partitionId(), 0, [np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64), np.zeros((0, width), np.int32)]

        def group(n):
            ids, labels, vectors = (x[:n] for x in held)
            return pa.RecordBatch.from_pylist([{"group": (part << 32) + made, "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": vectors.tobytes(),
                                                "least": np.full(n, _LOW).tobytes(), "most": np.full(n, _HIGH).tobytes()}])

        for batch in batches:
            for r in range(batch.num_rows):
                ids, labels, vectors, flags = (batch.column(c)[r].as_py() for c in ("ids", "labels", "vectors", "anchors"))
                mine = np.frombuffer(flags, bool)
                new = _longs(ids)[mine], _longs(labels)[mine], np.frombuffer(vectors, np.int32).reshape(-1, width)[mine]
                held = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
                while len(held[0]) >= size:
                    yield group(size)
                    held, made = [x[size:] for x in held], made + 1
        if len(held[0]):
            yield group(len(held[0]))

    return cut_lineage(packed.select("ids", "labels", "vectors", "anchors").transform(in_arrow, run, _GROUP))


class _Group:
    """A group row: anchors, and for each anchor the windows [least, most] of scores that it needs."""

    def __init__(self, row: dict, width: int):
        self.number, self.vectors = row["group"], _matrix(row["vectors"], width)
        self.ids, self.labels = _longs(row["ids"])[:, 0], _longs(row["labels"])[:, 0]
        n = len(self.ids)
        self.least, self.most = (np.frombuffer(row[c], np.int64).reshape(n, -1).copy() for c in ("least", "most"))

    def meets(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(anchors, blocks): whether bounds [low, high] (anchors, blocks) meet one of the anchor's windows."""
        out = np.zeros(low.shape, bool)
        for w in range(self.least.shape[1]):
            out |= (self.least[:, w, None] <= self.most[:, w, None]) & (high >= self.least[:, w, None]) & (low <= self.most[:, w, None])
        return out


def _streamed(batches, keys: tuple[str, str], first, second) -> Iterator:
    """Rows sorted by `keys` and `kind`: `first(row, fresh)` takes those of kind 0, `second(row, known)` those of kind 1."""
    key = None
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            now = tuple(row[k] for k in keys)
            if row["kind"] == 0:
                first(row, now != key)
                key = now
            elif now == key:
                yield from second(row)


def chosen(packed: DataFrame, groups: DataFrame, width: int, slices: int, same: bool, seeds: int = 0) -> DataFrame:
    """(group, bucket, slice, wanted): the blocks of each bucket whose zone maps don't rule them out for the group.

    A block counts for an anchor if it has a row of the anchor's label (`same`), or else of another, and the bounds of
    its scores meet one of the anchor's windows. With `seeds`, only the blocks of the highest upper bounds count, as
    many as hold `seeds` rows of the anchor's label.
    """
    zones = packed.select("bucket", "block", "labels", "low", "high")
    shards = max(1, math.ceil(packed.select("bucket").distinct().count() / ZONE_BUCKETS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    zones = zones.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(shards)).cast("int")).withColumn("slice", every(slices))
    asked = groups.select("group", *[F.col(c).alias(f"g_{c}") for c in ("ids", "labels", "vectors", "least", "most")]).withColumn(
        "slice", F.pmod(F.xxhash64("group"), F.lit(slices)).cast("int")).withColumn("shard", every(shards))
    both = zones.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind", "bucket", "block")

    def run(batches):
        known: dict[str, list] = {}

        def zone(row, fresh):
            if fresh:
                known.clear()
            labels, many = np.unique(_longs(row["labels"])[:, 0], return_counts=True)
            for name, value in (("bucket", row["bucket"]), ("block", row["block"]), ("low", _matrix(row["low"], width)), ("high", _matrix(row["high"], width)),
                                ("labels", labels), ("many", many)):
                known.setdefault(name, []).append(value)
            known.pop("all", None)

        def group(row):
            if "all" not in known:
                known["all"] = [np.array(known["bucket"]), np.array(known["block"]), np.concatenate(known["low"]), np.concatenate(known["high"])]
                known["of"] = np.repeat(np.arange(len(known["block"])), [len(x) for x in known["labels"]])
            bucket, block, low, high = known["all"]
            ask = _Group({"group": row["group"]} | {c: row[f"g_{c}"] for c in ("ids", "labels", "vectors", "least", "most")}, width)
            least, most = bounds(ask.vectors, low, high)
            label, many = np.concatenate(known["labels"]), np.concatenate(known["many"])
            have = np.zeros((len(ask.ids), len(block)), np.int64)
            for one in np.unique(ask.labels):
                hit = label == one
                have[ask.labels == one] = np.bincount(known["of"][hit], many[hit], len(block)).astype(np.int64)
            if not same:
                have = np.bincount(known["of"], many, len(block)).astype(np.int64) - have
            good = (have > 0) & ask.meets(least, most)
            if seeds:
                order = np.argsort(np.where(good, -most, _HIGH), axis=1, kind="stable")
                rows = np.take_along_axis(np.where(good, have, 0), order, 1)
                taken = np.zeros(good.shape, bool)
                np.put_along_axis(taken, order, np.cumsum(rows, axis=1) - rows < seeds, 1)
                good &= taken
            wanted = good.any(0)
            out = [{"group": ask.number, "bucket": int(b), "slice": row["slice"], "wanted": block[wanted & (bucket == b)].tolist()} for b in np.unique(bucket[wanted])]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("group", pa.int64()), ("bucket", pa.int64()), ("slice", pa.int32()), ("wanted", pa.list_(pa.int64()))]))

        yield from _streamed(batches, ("shard", "slice"), zone, group)

    return cut_lineage(both.transform(in_arrow, run, "group long, bucket long, slice int, wanted array<long>"))


def best(ask: _Group, held: list[tuple], same: bool, top: int) -> tuple[np.ndarray, ...]:
    """The `top` rows of each window over blocks (ids, labels, vectors, low, high), as (anchor, window, score, id).

    Blocks are read from the highest upper bound down; once a window is full its floor rises to its last score, and
    blocks that stay below all floors are not read.
    """
    windows = ask.least.shape[1]
    found = tuple(np.zeros(0, np.int64) for _ in range(4))
    low, high = bounds(ask.vectors, np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]))
    for k in np.argsort(-high.max(0), kind="stable"):
        if not ask.meets(low[:, k, None], high[:, k, None]).any():
            continue
        ids, labels, vectors = held[k][:3]
        score = product(ask.vectors, vectors)
        fits = ((ask.labels[:, None] == labels) == same) & (ask.ids[:, None] != ids)
        inside = fits[:, None, :] & (score[:, None, :] >= ask.least[:, :, None]) & (score[:, None, :] <= ask.most[:, :, None])
        a, w, r = np.nonzero(inside)
        if not len(a):
            continue
        a, w, s, i = (np.concatenate(x) for x in zip(found, (a, w, score[a, r], ids[r]), strict=True))
        order = np.lexsort((i, -s, a * windows + w))
        slot = (a * windows + w)[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order = order[place < top]
        found = a[order], w[order], s[order], i[order]
        last = place[place < top] == top - 1
        ask.least[found[0][last], found[1][last]] = found[2][last]
    return found


def searched(packed: DataFrame, groups: DataFrame, wanted: DataFrame, width: int, slices: int, same: bool, top: int) -> DataFrame:
    """(group, at, window, anchor, rank, score, other): the best rows of each window of each anchor in the wanted blocks."""
    read = wanted.select("bucket", "slice", F.explode("wanted").alias("block")).distinct()
    rows = packed.drop("anchors").join(read, ["bucket", "block"]).withColumn("kind", F.lit(0))
    asked = groups.select("group", *[F.col(c).alias(f"g_{c}") for c in ("ids", "labels", "vectors", "least", "most")]).join(wanted, "group")
    both = rows.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "kind", "block")
    schema = pa.schema([("group", pa.int64()), ("at", pa.int32()), ("window", pa.int32()), ("anchor", pa.int64()), ("score", pa.int64()), ("other", pa.int64())])

    def run(batches):
        held: dict[int, tuple] = {}

        def block(row, fresh):
            if fresh:
                held.clear()
            held[row["block"]] = (_longs(row["ids"])[:, 0], _longs(row["labels"])[:, 0], _matrix(row["vectors"], width),
                                  _matrix(row["low"], width), _matrix(row["high"], width))

        def group(row):
            ask = _Group({"group": row["group"]} | {c: row[f"g_{c}"] for c in ("ids", "labels", "vectors", "least", "most")}, width)
            a, w, s, i = best(ask, [held[b] for b in row["wanted"]], same, top)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), ask.number)), pa.array(a.astype(np.int32)), pa.array(w.astype(np.int32)),
                                                  pa.array(ask.ids[a]), pa.array(s), pa.array(i)], schema=schema)

        yield from _streamed(batches, ("bucket", "slice"), block, group)

    found = both.transform(in_arrow, run, "group long, at int, window int, anchor long, score long, other long")
    rank = F.row_number().over(Window.partitionBy("group", "at", "window").orderBy(F.col("score").desc(), "other"))
    return cut_lineage(found.withColumn("rank", rank).filter(F.col("rank") <= top))


def _windows(groups: DataFrame, found: DataFrame, make) -> DataFrame:
    """The groups with other windows: `make(anchors, rows)` gives (least, most) from the rows (at, rank, score) of a group."""
    per = found.groupBy("group").agg(F.collect_list(F.struct("at", "rank", "score")).alias("rows"))  # a few for each anchor of a group

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = np.array([(r["at"], r["rank"] - 1, r["score"]) for r in row.pop("rows") or ()], np.int64).reshape(-1, 3)
                least, most = make(len(row["ids"]) // 8, *rows.T)
                out.append(row | {"least": least.tobytes(), "most": most.tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(n, pa.int64() if n == "group" else pa.binary()) for n in batch.schema.names if n != "rows"]))

    return cut_lineage(groups.join(per, "group", "left").select(*groups.columns, "rows").transform(in_arrow, run, _GROUP))


def hard_negatives(rows: DataFrame, id_col: str, label: Column, vector: str, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   share: tuple[int, int] = SHARE, unit: int = UNIT, block_rows: int = BLOCK_ROWS, bucket_blocks: int = BUCKET_BLOCKS,
                   group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that `anchor` selects.

    The score of two rows is the inner product of their vectors in integer steps, floor(unit * x) for a component x.
    Higher scores come first, then smaller ids. The positives of an anchor are its first `positives` rows of the same
    label and another id; the negatives of a positive are the first `negatives` rows of another label whose score lies
    between `share` of the positive's score and that score. A positive without negatives has no row.

    Rows with a null label, a null vector, or a null or non-finite component take no part. An empty vector has score zero;
    a shorter vector is filled up with zeros. Components beyond 2^23 steps count as 2^23. A row without id is no
    anchor, comes after all other ids and is reported with a null id. Rows that share an id take part each by itself, but not as each other's
    positive or negative; an anchor that repeats repeats its result. Ties of score and id are equal rows of the result.
    Other columns are left out, so their names can't clash. Empty table: no rows.
    """
    narrow = usable(rows.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.col(f"`{vector}`").alias("vector"), anchor.alias("anchor")))
    packed, width = blocks(narrow.withColumn("anchor", F.col("anchor") & F.col("id").isNotNull()), unit, block_rows, bucket_blocks)
    groups = anchor_groups(packed, width, group)
    slices = max(1, math.ceil(groups.count() / GROUPS))

    def search(asked: DataFrame, same: bool, top: int, seeds: int = 0) -> DataFrame:
        return searched(packed, asked, chosen(packed, asked, width, slices, same, seeds), width, slices, same, top)

    def floors(n, at, rank, score):
        least = np.full((n, 1), _LOW)
        least[at[rank == positives - 1], 0] = score[rank == positives - 1]
        return least, np.full((n, 1), _HIGH)

    def shares(n, at, rank, score):
        least, most = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)  # empty until filled
        least[at, rank], most[at, rank] = -(-score * share[0] // share[1]), score
        return least, most

    near = search(_windows(groups, search(groups, True, positives, seeds=positives + 1), floors), True, positives)
    far = search(_windows(groups, near, shares), False, negatives)
    pairs = near.select("group", "at", (F.col("rank") - 1).alias("window"), "anchor", F.col("other").alias("positive"), F.col("score").alias("positive_score"))
    known = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    return pairs.join(far.drop("anchor"), ["group", "at", "window"]).select(
        F.col("anchor").alias("anchor_id"), known("positive").alias("positive_id"), "rank", known("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))

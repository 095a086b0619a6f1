"""Line dedup by probing perfect hash tables of the lines that many documents share.

Every line has a key, stripped and in lower case, and a 64-bit code of it. Codes are counted over all documents; those
found often enough, each with its count and the greatest doc_id that holds it, are cut into shards by code. A shard is a
minimal perfect hash: bitmaps of falling size, in each of which a code takes the place its hash names unless another
code wants it too; the number of set bits before a code's place is its index into dense arrays of fingerprints, counts
and keepers. Documents probe these arrays with the codes of their lines, and the fingerprint (the code itself) turns
away what isn't in the table. No line is joined and no text moves as long as the arrays are within a checked size; beyond
it codes, not lines, are sent to the shards, salted so that a line of very many documents spreads.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from .tokens import BLANK, LOWER, buffers, in_arrow, mixed, pieces, prefix_sums, span_codes

MIN_CHARS, MIN_DOCS = 40, 5
#: Codes of one shard, on average.
SHARD_KEYS = 1 << 17
#: Packed shards up to this size go to every task; beyond it codes go to the shards.
BROADCAST_BYTES = 64 << 20
#: Tasks that share the probes of one shard where codes are sent.
SALTS = 16
#: Bits of a bitmap for each code that is still without a place.
_ROOM = 2


@dataclass
class Lines:
    """Lines of a text column: where each starts and ends, the first of each row, and the codes of those that count."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    counted: np.ndarray
    codes: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def lines(column: pa.Array, min_chars: int = MIN_CHARS) -> Lines:
    """Lines parted by line feeds; `counted` are those whose key has at least `min_chars` code points."""
    data, offsets = buffers(column)
    breaks = np.flatnonzero(data == 10)
    many = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    starts[is_first], starts[~is_first] = offsets[:-1], breaks + 1
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    ends[is_last], ends[~is_last] = offsets[1:], breaks
    solid = np.flatnonzero(~BLANK[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(high > low)
    key_start, key_end = solid[low[full]], solid[high[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[key_end] - points[key_start] >= min_chars
    counted = full[long]
    codes = span_codes(prefix_sums(LOWER[data]), key_start[long], key_end[long]) if len(counted) else np.zeros(0, np.uint64)
    return Lines(starts, ends, first, counted, codes)


def _place(codes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(codes + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)


def perfect_hash(codes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the bitmaps and their bits, one after another, of a minimal perfect hash over distinct codes."""
    sizes, maps = [], []
    while len(codes):
        size = _ROOM * len(codes) + 7 & ~7
        place = _place(codes, len(sizes), size)
        wanted = np.bincount(place, minlength=size)
        maps.append(wanted == 1)
        sizes.append(size)
        codes = codes[wanted[place] > 1]
    return sizes, np.packbits(np.concatenate(maps)) if maps else np.zeros(0, np.uint8)


class Shard:
    """A shard taken from its row: index of codes, fingerprints, counts and keepers."""

    def __init__(self, sizes: np.ndarray, bits: bytes, prints: bytes, docs: bytes, keepers: pa.Array):
        self.sizes = sizes.tolist()
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        self.rank = np.concatenate([[0], np.cumsum(self.bits)])
        self.prints, self.docs, self.keepers = np.frombuffer(prints, np.uint64), np.frombuffer(docs, np.uint32), keepers

    def index(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code, -1 if no bitmap has its place set; codes of the table get distinct indexes without gaps."""
        out, base, left = np.full(len(codes), -1), 0, np.arange(len(codes))
        for level, size in enumerate(self.sizes):
            at = base + _place(codes[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out

    def dropped(self, codes: np.ndarray, ids: pa.Array, min_docs: int) -> np.ndarray:
        """Which lines go, given each line's code and its document's id."""
        at = self.index(codes)
        found = np.flatnonzero(at >= 0)
        found = found[(self.prints[at[found]] == codes[found]) & (self.docs[at[found]] >= min_docs)]
        out = np.zeros(len(codes), bool)
        if len(found):
            keeper, own = self.keepers.take(pa.array(at[found])), ids.take(pa.array(found))
            same = pc.or_(pc.fill_null(pc.equal(keeper, own), False), pc.and_(pc.is_null(keeper), pc.is_null(own)))
            out[found] = ~same.to_numpy(zero_copy_only=False)
        return out


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return (codes >> np.uint64(32)).astype(np.int64) % shards


def _codes(docs: DataFrame, columns: int, min_chars: int) -> DataFrame:
    """The first `columns` columns of `docs` and `code`, once for each key of a row that counts; the next column is the text."""
    schema = T.StructType([*docs.schema.fields[:columns], T.StructField("code", T.LongType())])

    def run(batches):
        for batch in batches:
            for low, high in pieces(batch.column(columns)):
                part = batch.slice(low, high - low)
                found = lines(part.column(columns), min_chars)
                row = found.row[found.counted]
                by = np.lexsort((found.codes, row))
                row, codes = row[by], found.codes[by]
                new = np.ones(len(by), bool)
                new[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
                at = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in range(columns)], pa.array(codes[new].view(np.int64))], schema.names)

    return docs.transform(in_arrow, run, schema)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(code, docs, keeper) of (id, text): in how many rows a key is found, and the greatest id of them."""
    return _codes(docs, 1, min_chars).groupBy("code").agg(F.count("*").alias("docs"), F.max("id").alias("keeper"))


def shard_table(counts: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of (code, docs, keeper): bitmaps and the arrays that the perfect hash points into."""
    dealt = counts.withColumn("shard", F.shiftrightunsigned("code", 32) % shards)
    kind = counts.schema["keeper"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("sizes", T.ArrayType(T.LongType())),
                           *[T.StructField(c, T.BinaryType()) for c in ("bits", "prints", "docs")], T.StructField("keepers", T.ArrayType(kind))])

    def pack(table: pa.Table) -> pa.Table:
        codes = table.column("code").to_numpy().view(np.uint64)
        sizes, bits = perfect_hash(codes)
        made = Shard(np.array(sizes), bits.tobytes(), b"", b"", None)
        by = np.argsort(made.index(codes))
        keepers = table.column("keeper").combine_chunks().take(pa.array(by))
        docs = np.minimum(table.column("docs").to_numpy(), 2**32 - 1).astype(np.uint32)
        return pa.table([pa.array([table.column("shard")[0].as_py()]), pa.array([sizes], pa.list_(pa.int64())), pa.array([bits.tobytes()]),
                         pa.array([codes[by].tobytes()]), pa.array([docs[by].tobytes()]),
                         pa.ListArray.from_arrays(pa.array([0, len(by)], pa.int32()), keepers)], schema.names)

    return dealt.groupBy("shard").applyInArrow(pack, schema)


def _taken(table: pa.Table | pa.RecordBatch, row: int) -> Shard:
    bits, prints, docs = (table.column(c)[row].as_py() for c in ("bits", "prints", "docs"))
    return Shard(table.column("sizes")[row].values.to_numpy(), bits, prints, docs, table.column("keepers")[row].values)


_opened: dict[str, dict[int, Shard]] = {}


def _open(sent) -> dict[int, Shard]:
    """The shards of a broadcast, unpacked once in a worker."""
    name, packed = sent.value
    if name not in _opened:
        _opened.clear()
        table = pa.ipc.open_stream(packed).read_all().combine_chunks()
        _opened[name] = {s: _taken(table, k) for k, s in enumerate(table.column("shard").to_pylist())}
    return _opened[name]


def _cut(column: pa.Array, found: Lines, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts without the lines `gone`, and how many each row lost."""
    lost = np.add.reduceat(gone.astype(np.int64), found.first[:-1]) if len(gone) else np.zeros(0, np.int64)
    if not lost.any():
        return column.fill_null(""), lost
    data, offsets = buffers(column)
    raw, texts = data.tobytes(), []
    for r in range(len(lost)):
        if not lost[r]:
            texts.append(raw[offsets[r] : offsets[r + 1]])
        else:
            kept = found.first[r] + np.flatnonzero(~gone[found.first[r] : found.first[r + 1]])
            texts.append(b"\n".join([raw[found.starts[k] : found.ends[k]] for k in kept]))
    return pa.array(texts, pa.binary()).cast(pa.string()), lost


def _result(batch: pa.RecordBatch, drop, names: list[str], min_chars: int):
    """Pieces of (row, id, text, …) with their lines dropped; `drop` tells the lines that go from (piece, lines, rows)."""
    for low, high in pieces(batch.column(2)):
        part = batch.slice(low, high - low)
        found = lines(part.column(2), min_chars)
        gone = np.zeros(len(found.starts), bool)
        if len(found.counted):
            gone[found.counted] = drop(part, found, found.row[found.counted])
        texts, lost = _cut(part.column(2), found, gone)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(found.first)), pa.array(lost), texts], names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                    shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, n_lines, n_dropped, text): `row` has the other columns of `docs`, `text` the lines that stay.

    A text is split at line feeds. The key of a line is the line without blanks (`[\\x20\\x09-\\x0D]`) at both ends and
    with A-Z in lower case. A key of at least `min_chars` code points that at least `min_docs` rows hold loses all its
    lines but those of the greatest id that holds it; there all of them stay. The lines that stay are joined as they are.

    Null and empty texts have one empty line, which stays. Rows without an id stand below all others; where only such
    rows hold a key, all of them keep it. Rows that share an id count as documents of their own, and all with the
    greatest id keep their lines. The other columns travel in one struct, so their names can't clash. Empty table: no
    rows. Equal keys have equal codes; two different ones share a code with a chance of about 2^-64.
    """
    spark, rest = docs.sparkSession, [F.col(f"`{c}`") for c in docs.columns if c != text]
    marked = docs.select(F.struct(*rest).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    often = cut_lineage(line_counts(marked.select("id", "text"), min_chars).filter(F.col("docs") >= min_docs))
    shards = max(1, math.ceil(often.count() / shard_keys))
    table = cut_lineage(shard_table(often, shards))
    packed = table.agg(F.sum(F.length("bits") + F.length("prints") + F.length("docs") + 16 * F.size("keepers"))).first()[0] or 0
    schema = T.StructType([marked.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                           T.StructField("text", T.StringType())])
    if packed > broadcast_bytes:
        return _by_shuffle(marked, table, shards, schema, min_chars, min_docs)
    arrow, sink = table.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrow.schema) as out:
        out.write_table(arrow)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, sink.getvalue().to_pybytes()))

    def run(batches):
        known = _open(sent)

        def drop(part, found, rows):
            shard, gone = _shard_of(found.codes, shards), np.zeros(len(found.codes), bool)
            for s in np.unique(shard).tolist():
                if s in known:
                    at = np.flatnonzero(shard == s)
                    gone[at] = known[s].dropped(found.codes[at], part.column(1).take(pa.array(rows[at])), min_docs)
            return gone

        for batch in batches:
            yield from _result(batch, drop, schema.names, min_chars)

    return marked.transform(in_arrow, run, schema)


def _by_shuffle(marked: DataFrame, table: DataFrame, shards: int, schema: T.StructType, min_chars: int, min_docs: int) -> DataFrame:
    """As `without_repeats`, with the codes of the lines sent to the shards and their answers to the documents.

    What a line's fate depends on is its document's id and its code, so rows with equal id and text share an answer.
    """
    marked = marked.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    probes = _codes(marked.select("id", "h", "text"), 2, min_chars).withColumn("shard", F.shiftrightunsigned("code", 32) % shards)
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("id", "h"), F.lit(SALTS)))
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = salted.withColumn("probe", F.lit(0)).unionByName(probes.withColumn("probe", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "probe")
    gone = T.StructType([*[marked.schema[c] for c in ("id", "h")], T.StructField("code", T.LongType())])

    def probe(batches):
        shard = key = None
        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            is_probe = batch.column("probe").to_numpy() == 1
            new = np.ones(len(keys), bool)
            new[1:] = [a != b for a, b in zip(keys[1:], keys[:-1], strict=True)]
            heads = [*np.flatnonzero(new | ~is_probe).tolist(), len(keys)]
            for low, high in zip(heads[:-1], heads[1:], strict=True):
                if not is_probe[low]:
                    shard, key = _taken(batch, low), keys[low]
                    low += 1
                if low < high and key == keys[low]:  # a shard without table has no line that goes
                    part = batch.slice(low, high - low)
                    codes = part.column("code").to_numpy()
                    at = pa.array(np.flatnonzero(shard.dropped(codes.view(np.uint64), part.column("id"), min_docs)))
                    yield pa.RecordBatch.from_arrays([part.column(c).take(at) for c in gone.names], gone.names)

    answers = both.transform(in_arrow, probe, gone).groupBy("id", "h").agg(F.collect_set("code").alias("codes"))
    answers = answers.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "codes")
    told = marked.join(answers, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("row", "id", "text", "codes")

    def cut(batches):
        def drop(part, found, rows):
            out = np.zeros(len(rows), bool)
            for r in np.unique(rows).tolist():
                if part.column(3)[r].is_valid:
                    at = np.flatnonzero(rows == r)
                    out[at] = np.isin(found.codes[at], part.column(3)[r].values.to_numpy().view(np.uint64))
            return out

        for batch in batches:
            yield from _result(batch, drop, schema.names, min_chars)

    return told.transform(in_arrow, cut, schema)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs` with the lines that many documents share left only in the document of the greatest id; no row goes."""
    found = without_repeats(docs, id_col, text, **settings)
    return found.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])

"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; where its value at the end of a word is small, a chunk ends. Cuts depend
on the last 16 bytes alone, so an insertion shifts nothing beyond the next cut and a passage has the same chunks in
every document. Chunks are compared by digest. The first document (by doc_id) that holds a chunk keeps it; in the
others it is a repeat. Repeats that follow each other, with the words around them that agree with the first place
too, make a span; long spans are cut out.

Work per step: (1) each task counts its digests, and one aggregation finds those in two documents or more; (2) a
bitmap of them, of bounded size, goes to the tasks, which send only chunks that may repeat; the exact comparison
follows in joins; (3) documents meet their own spans by key. What the bitmap lets through by mistake costs rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from .tokens import Runs, buffers, in_arrow, mixed, pieces, prefix_sums, span_codes, words

#: One word in so many ends a chunk.
CHUNK_WORDS = 6
#: A chunk of more words is cut after so many, for texts that repeat one word without a natural cut.
LONGEST_CHUNK = 16
#: Shorter chunks repeat by chance; they aren't compared, the agreement around their neighbours covers them.
LEAST_CHUNK = 4
#: Words of a repeated span from which on it is cut out. A passage of over 50 words keeps at least so many in whole
#: chunks and their agreeing surroundings but for about one in fifty of the shortest.
MIN_WORDS = 40
#: Bits of the bitmap at most (32 MB).
MAX_BITS = 1 << 28
#: Words of the bitmap that one task merges and the driver gets in one row (256 KB).
BLOCK_WORDS = 1 << 15
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_SIDE = 16


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """h = 2 h + gear[byte] modulo 2^16 at every byte, starting anew in each row: sums over the last 16 bytes."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + 16 * (row + 1)
    h = np.zeros(len(data) + 16 * len(offsets), np.uint16)
    h[at] = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h[at]


def chunks(column: pa.Array) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a piece, the first and the last + 1 word of each chunk that is compared, and the digests."""
    data, offsets = buffers(column)
    found = words(data, offsets, lower=False)
    n = len(found.starts)
    ends = gear(data, offsets)[found.ends - 1] < 65536 // CHUNK_WORDS
    lasts = found.first[1:][np.diff(found.first) > 0] - 1
    ends[lasts] = True
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]]) if n else stop
    start, stop = _joined(start, stop, found.row[start])
    more = (stop - start - 1) // LONGEST_CHUNK
    forced = np.repeat(start, more) + LONGEST_CHUNK * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    start, stop = np.sort(np.concatenate([start, forced])), np.sort(np.concatenate([stop, forced]))
    long = stop - start >= LEAST_CHUNK
    start, stop = start[long], stop[long]
    return found, start, stop, span_codes(prefix_sums(found.codes), start, stop)


def _joined(start: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join four or more short chunks in a row into one, as where a repeated word is a cut each time."""
    short = stop - start < LEAST_CHUNK
    head = np.ones(len(start), bool)
    head[1:] = ~(short[1:] & short[:-1] & (row[1:] == row[:-1]))
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(start)))
    inner = np.repeat(size >= 4, size)
    return start[head | ~inner], stop[np.append(head[1:], True) | ~inner] if len(stop) else stop


def _bits(digests: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(size - 1)
    return digests & top, mixed(digests) & top


def repeated_digests(texts: DataFrame) -> DataFrame:
    """Digests (d) of chunks that stand in two rows of (text) or more."""

    def run(batches):
        for batch in batches:
            column, parts = batch.column(0), []
            for low, high in pieces(column):
                found, start, _, digest = chunks(column.slice(low, high - low))
                row = found.row[start] if len(start) else start
                order = np.lexsort((row, digest))
                d, r = digest[order], row[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])  # once per row
                parts.append(d[new])
            d, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), pa.array(n.astype(np.int32))], ["d", "n"])

    return texts.transform(in_arrow, run, "d long, n int").groupBy("d").agg(F.sum("n").alias("n")).filter("n > 1").select("d")


def bitmap(digests: DataFrame, n: int) -> np.ndarray:
    """A bitmap of at most MAX_BITS with two bits set for each digest.

    Words of 64 bits meet by block of BLOCK_WORDS and are merged in the tasks; the driver gets one row for each block.
    """
    size = 1 << 16
    while size < min(16 * n, MAX_BITS):
        size *= 2
    width = min(BLOCK_WORDS, size // 64)

    def run(batches):
        part = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(part, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array((used // width).astype(np.int32)), pa.array((used % width).astype(np.int32)),
                                          pa.array(part[used].view(np.int64))], ["block", "w", "bits"])

    def merged(batches):
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            block, w, bits = (batch.column(c).to_numpy() for c in range(3))
            for k in np.unique(block).tolist():
                own = block == k
                np.bitwise_or.at(whole.setdefault(k, np.zeros(width, np.uint64)), w[own], bits[own].view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([*whole], pa.int32()), pa.array([b.tobytes() for b in whole.values()], pa.binary())], ["block", "words"])

    blocks = digests.transform(in_arrow, run, "block int, w int, bits long").repartition("block").transform(in_arrow, merged, "block int, words binary")
    out = np.zeros(size // 64, np.uint64)
    for batch in blocks.toArrow().to_batches():
        for k, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[k * width : (k + 1) * width] = np.frombuffer(words.as_buffer(), np.uint64)
    return out


def in_bitmap(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    hit = np.ones(len(digests), bool)
    for at in _bits(digests, 64 * len(bits)):
        hit &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _around(found: Runs, edge: np.ndarray, row: np.ndarray, step: int) -> list[np.ndarray]:
    """One byte for each of the 16 words from `edge` on (step 1) or before it (step -1), in two longs; 0 past the text."""
    marks = (found.codes % np.uint64(255)).astype(np.uint64) + np.uint64(1)
    low, high = found.first[row], found.first[row + 1]
    out = []
    for half in range(2):
        packed = np.zeros(len(edge), np.uint64)
        for k in range(8):
            at = edge + (8 * half + k if step > 0 else -1 - 8 * half - k)
            good = (at >= low) & (at < high)
            packed |= np.where(good, marks[np.clip(at, 0, max(len(marks) - 1, 0))], np.uint64(0)) << np.uint64(8 * k)
        out.append(packed.view(np.int64))
    return out


def candidate_chunks(keyed: DataFrame, bits) -> DataFrame:
    """(id, h, d, pos, n, l1, l2, r1, r2) of the chunks of (id, h, text) that the bitmap lets through."""
    schema = T.StructType([*keyed.schema.fields[:2], T.StructField("d", T.LongType()), T.StructField("pos", T.IntegerType()),
                           T.StructField("n", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("l1", "l2", "r1", "r2")]])

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            for low, high in pieces(column):
                found, start, stop, digest = chunks(column.slice(low, high - low))
                hit = np.flatnonzero(in_bitmap(bits.value, digest))
                if not len(hit):
                    continue
                start, stop = start[hit], stop[hit]
                row = found.row[start]
                take = pa.array(low + row)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(digest[hit].view(np.int64)),
                    pa.array((start - found.first[row]).astype(np.int32)), pa.array((stop - start).astype(np.int32)),
                    *map(pa.array, _around(found, start, row, -1)), *map(pa.array, _around(found, stop, row, 1))], schema.names)

    return keyed.transform(in_arrow, run, schema)


def _agreeing(pairs: list[tuple[str, str]]) -> Column:
    """How many bytes of two 16-byte marks agree from the first on."""
    def count(a: str, b: str) -> Column:
        x = F.col(a).bitwiseXOR(F.col(b))
        out = F.when(x.bitwiseAND(255) != 0, 0)
        for k in range(1, 8):
            out = out.when(x.bitwiseAND((1 << (8 * k + 8)) - 1 if k < 7 else -1) != 0, k)
        return out.otherwise(8)

    first, second = (count(a, b) for a, b in pairs)
    return F.when(first < 8, first).otherwise(first + second)


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, found): the repeated chunks of each document that has some, with the words that agree around them."""
    sc = docs.sparkSession.sparkContext
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("h"), F.col(f"`{text}`").alias("text"))
    digests = cut_lineage(repeated_digests(keyed.select("text")))
    bits = sc.broadcast(bitmap(digests, digests.count()))
    rows = cut_lineage(candidate_chunks(keyed, bits))
    place = ("isnull", "id", "h", "pos", "l1", "l2", "r1", "r2")
    first = rows.withColumn("isnull", F.col("id").isNull()).groupBy("d").agg(
        F.min(F.struct(*place)).alias("o"), F.count("*").alias("rows")).filter("rows > 1")
    first = cut_lineage(first.select("d", *[F.col(f"o.{c}").alias(f"o{c}") for c in place[1:]]))
    others = rows.join(first, "d").filter(~(F.col("id").eqNullSafe(F.col("oid")) & (F.col("h") == F.col("oh"))))
    left, right = (_agreeing([(f"{s}{k}", f"o{s}{k}") for k in (1, 2)]) for s in "lr")
    # rows that agree in id and text are one document: their chunks count once
    return (others.select("id", "h", "pos", "n", left.alias("before"), right.alias("after")).repartition("id", "h")
            .groupBy("id", "h", "pos").agg(F.min("n").alias("n"), F.max("before").alias("before"), F.max("after").alias("after"))
            .groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "before", "after"))).alias("found")))


def spans_of(found: list[dict], n_words: int, least: int) -> list[tuple[int, int]]:
    """Spans [begin, end) of at least `least` words from sorted chunks: neighbours join, then what touches."""
    ranges: list[list[int]] = []
    k = 0
    while k < len(found):
        last = k
        while last + 1 < len(found) and found[last + 1]["pos"] == found[last]["pos"] + found[last]["n"]:
            last += 1
        begin = max(0, found[k]["pos"] - found[k]["before"])
        end = min(n_words, found[last]["pos"] + found[last]["n"] + found[last]["after"])
        if ranges and begin <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([begin, end])
        k = last + 1
    return [(a, b) for a, b in ranges if b - a >= least]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` as a struct `row` with (text, n_words, n_removed, spans): the text without its repeated spans.

    A span is a run of at least `min_words` words that stands, chunk by chunk, verbatim in documents with a lesser
    doc_id (null last, then by a hash of the text); words are parted by ASCII blanks and compared with their case.
    The blanks behind a removed word go with it, all other bytes stay. `spans` are [begin, end) in words of the
    original text. Repeats inside one document stay.

    Null text: null, no words, no spans. Empty and short texts: unchanged. Rows that agree in doc_id and text are one
    document and keep what one of them keeps. Empty table: no rows. Columns of `docs` travel in the struct.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("h"),
                        F.col(f"`{text}`").alias("text"))
    found = repeats(docs, id_col, text).withColumnRenamed("id", "fid").withColumnRenamed("h", "fh")
    joined = keyed.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left").select("row", "text", "found")
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    fields = [T.StructField("row", keyed.schema["row"].dataType), T.StructField("text", T.StringType()),
              T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])))]

    def run(batches):
        for batch in batches:
            column, rows = batch.column(1), batch.column(2)
            texts, totals, removed, spans = [], [], [], []
            for low, high in pieces(column):
                piece = column.slice(low, high - low)
                data, offsets = buffers(piece)
                w = words(data, offsets, lower=False)
                counts = np.diff(w.first)
                keep = np.ones(len(data), bool)
                for k in range(high - low):
                    cut = spans_of(rows[low + k].as_py(), int(counts[k]), min_words) if rows[low + k].is_valid else []
                    for a, b in cut:
                        end = w.starts[w.first[k] + b] if b < counts[k] else offsets[k + 1]
                        keep[w.starts[w.first[k] + a] : end] = False
                    spans.append([{"begin": a, "end": b} for a, b in cut])
                    removed.append(sum(b - a for a, b in cut))
                kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
                data = data[keep].tobytes()
                texts.extend(data[kept[k] : kept[k + 1]].decode() if piece[k].is_valid else None for k in range(high - low))
                totals.extend(counts.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()),
                                              pa.array(removed, pa.int64()), pa.array(spans, span)], [f.name for f in fields])

    return joined.transform(in_arrow, run, T.StructType(fields))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = "n_chars",
                 min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the repeated spans cut out of the text, and `length`, if there, set to the new number of characters.

    A document of which no word is left goes.
    """
    cut = without_repeats(docs, id_col, text, min_words).filter("n_removed = 0 or n_removed < n_words")
    changed = {text: F.col("text"), length: F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row")[length]) if length in docs.columns else None}
    return cut.select(*[(changed[c] if c in changed else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])

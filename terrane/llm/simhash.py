"""SimHash near duplicates by bit-sliced comparison of fingerprints.

Equal fingerprints merge first, so a group of copies is one row. Two fingerprints with at most r differing bits out of
64, cut into r + 2 bands, agree on at least two bands: each fingerprint goes to the buckets that its pairs of bands
name, ten for three bits. Within a bucket fingerprints are compared in blocks of 64: a block stores one machine word per bit
position (the bit planes), a query word is compared with all 64 at once, and the distances are kept in carry-save
counters, one bit of every counter per word. After each eight planes the blocks whose counters are all beyond the
radius are left out. Buckets with more rows than a bound are cut into parts by hash, and every pair of parts is
compared by a task of its own, so no bucket is held whole by one task. Compared rows leave only a spanning forest,
never all pairs of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from .components import components
from .tokens import in_arrow

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Bands that cut the 64 bits for each radius. Two bands more than the radius leave two whole whichever bits differ.
BANDS = {radius: radius + 2 for radius in range(7)}
#: Rows of a bucket that one task compares with each other; larger buckets are cut into parts.
PART_ROWS = 1024
_ONES = np.uint64(2**64 - 1)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text in UTF-8: a bit is set if it is set in over half of the shingles' hashes."""
    # bytes.lower() changes A-Z alone, bytes.split() parts at the six blanks of ASCII
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[: len(words) - size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    stops = ends[size - 1 :].tolist()
    for k in range(0, len(starts), 1 << 16):  # a long text is summed up in steps
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)], strict=True)], np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """`docs` with the text replaced by `_fp`, its fingerprint as a signed long. A column `_fp` of `docs` is replaced."""
    names = [c for c in docs.columns if c not in (text, "_fp")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("binary").alias("_fp"))
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("_fp", T.LongType())])

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(v.as_py() or b"", shingle, seed) for v in batch.column(len(names))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*names, "_fp"])

    return docs.transform(in_arrow, run, schema)


def buckets(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The buckets of each distinct fingerprint: `pair` of bands, their bits as `key`; ten for radius 3, 28 for 6."""
    count, fp, low, parts = BANDS[radius], F.col("fp"), 64, []
    widths = [64 // count + (k < 64 % count) for k in range(count)]
    for width in widths:
        low -= width
        parts.append(F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1))
    rows = [F.struct(F.lit(n).alias("pair"), (F.shiftleft(parts[i], widths[j]) + parts[j]).alias("key"))
            for n, (i, j) in enumerate(combinations(range(count), 2))]
    return prints.select("fp", F.explode(F.array(*rows)).alias("b")).select("fp", "b.pair", "b.key")


def compared(prints: DataFrame, part_rows: int = PART_ROWS, radius: int = RADIUS) -> DataFrame:
    """Rows (pair, key, left, right, side, fp) such that the rows of one (pair, key, left, right) need comparing.

    A bucket within the bound is one cell (0, 0). A larger one has its rows dealt to parts by hash, and the cell of
    each pair of parts gets the rows of both, marked by `side`.
    """
    rows = cut_lineage(buckets(prints, radius))
    sizes = rows.groupBy("pair", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = cut_lineage(sizes.select("pair", "key", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")))
    dealt = rows.join(sizes, ["pair", "key"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.withColumn("other", other).select(
        "pair", "key", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "fp")


def near(planes: np.ndarray, rows: np.ndarray, radius: int) -> np.ndarray:
    """For pairs of blocks: a word for each row of the first block, with a bit for each near row of the second.

    `planes` (pairs, 64) are the bit planes of the second blocks, `rows` (pairs, 64) the fingerprints of the first.
    The counters saturate: four words hold the bits 1, 2 and 4 of 64 distances and whether a distance is 8 or more.
    """
    out = np.zeros(rows.shape, np.uint64)
    alive = np.arange(len(rows))
    one, two, four, over = (np.zeros(rows.shape, np.uint64) for _ in range(4))
    for start in range(0, 64, 8):
        p, r = planes[alive], rows[alive]
        for bit in range(start, start + 8):
            carry = p[:, bit, None] ^ (np.uint64(0) - ((r >> np.uint64(bit)) & np.uint64(1)))
            for counter in (one, two, four):
                carry, counter[...] = counter & carry, counter ^ carry
            over |= carry
        beyond = over | _above(one, two, four, radius)
        stay = (beyond != _ONES).any(1)
        if start + 8 == 64:
            out[alive] = ~beyond
        elif not stay.all():
            alive, one, two, four, over = alive[stay], one[stay], two[stay], four[stay], over[stay]
        if not len(alive):
            break
    return out


def _above(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Which of the counters 0 to 7 exceed `radius` (0 to 7), bit by bit from the highest."""
    above, equal = np.zeros_like(one), np.full_like(one, _ONES)
    for weight, counter in ((4, four), (2, two), (1, one)):
        if radius & weight:
            equal = equal & counter
        else:
            above, equal = above | (equal & counter), equal & ~counter
    return above


def _transposed(fps: np.ndarray) -> np.ndarray:
    """Bit planes (blocks, 64) of blocks of 64 fingerprints: bit i of plane j is bit j of fingerprint i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8").reshape(-1, 64)


def links(cell: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all near fingerprints of each cell; rows of a cell stand together, sorted by `side`.

    Rows are laid out in blocks of 64, small cells side by side; a block is compared with itself and with the later
    blocks that share a cell with it. Cells that compare two parts (with rows of side 1) compare side 0 with side 1
    only, as the parts have cells of their own.
    """
    n = len(fp)
    pad = -n % 64
    blocks = (n + pad) // 64
    cells = np.concatenate([cell, np.full(pad, -1)]).reshape(blocks, 64)
    sides = np.concatenate([side, np.zeros(pad, side.dtype)]).reshape(blocks, 64)
    fps = np.concatenate([fp, np.zeros(pad, np.uint64)]).reshape(blocks, 64)
    planes = _transposed(fps)
    last_cell = np.array([row[row >= 0][-1] for row in cells])
    reach = np.searchsorted(cells[:, 0], last_cell, "right")  # blocks that begin within the last cell of this one
    reach[reach < np.arange(1, blocks + 1)] = 0
    reach = np.maximum(reach, np.arange(1, blocks + 1))
    many = reach - np.arange(blocks)
    first = np.repeat(np.arange(blocks), many)
    second = first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    two_sided = np.zeros(int(cell.max()) + 1, bool)
    two_sided[cell[side == 1]] = True
    flat_cell, flat_side = cells.ravel(), sides.ravel()
    label = np.arange(n)
    for k in range(0, len(first), chunk):
        a, b = first[k : k + chunk], second[k : k + chunk]
        hits = near(planes[b], fps[a], radius)
        pair, row = np.nonzero(hits)
        if not len(pair):
            continue
        bits = np.unpackbits(hits[pair, row].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, col = np.nonzero(bits)
        x, y = a[pair[which]] * 64 + row[which], b[pair[which]] * 64 + col
        good = (x < y) & (flat_cell[x] == flat_cell[y]) & (flat_cell[x] >= 0)
        good &= ~two_sided[flat_cell[x]] | (flat_side[x] != flat_side[y])
        # each row keeps one link, so a chunk's hits are forgotten once they are merged
        tied = np.flatnonzero(label != np.arange(n))
        label = _merged(n, np.concatenate([tied, x[good]]), np.concatenate([label[tied], y[good]]))
    row = np.flatnonzero(label != np.arange(n))
    return fp[row], fp[label[row]]


def _merged(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each of `n` rows reaches over the links (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_links(prints: DataFrame, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that join all within `radius` bits, at most 6."""
    if radius not in BANDS:
        raise ValueError(f"radius must be 0 to {max(BANDS)}")
    rows = compared(prints, part_rows, radius)
    cell = ["pair", "key", "left", "right"]
    rows = rows.repartition(*cell).sortWithinPartitions(*cell, "side", "fp")

    def run(batches):
        kept = None

        def finish(table):
            cols = [table.column(c).to_numpy() for c in (*cell, "side", "fp")]
            new = np.ones(table.num_rows, bool)
            new[1:] = False
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            ids = np.cumsum(new) - 1
            alone = np.bincount(ids)[ids] == 1
            if alone.all():
                return
            _, packed = np.unique(ids[~alone], return_inverse=True)
            a, b = links(packed, cols[4][~alone], cols[5][~alone].view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch]).combine_chunks()
            cols = [table.column(c).to_numpy() for c in cell]
            edge = np.zeros(table.num_rows, bool)
            for c in cols:
                edge[1:] |= c[1:] != c[:-1]
            ends = np.flatnonzero(edge)
            if len(ends):
                yield from finish(table.slice(0, int(ends[-1])))
                table = table.slice(int(ends[-1]))
            kept = table
        if kept is not None and kept.num_rows:
            yield from finish(kept)

    return rows.transform(in_arrow, run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE,
                    seed: int = SEED, part_rows: int = PART_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: `keep` columns, doc_id, fingerprint (16 hex digits) and component_id.

    Two documents are linked if their fingerprints differ in at most `radius` bits; component_id is the least doc_id
    that can be reached over links, the document's own included.

    Null and empty texts and texts of blanks have fingerprint zero and are linked like any other. A text of fewer
    words than a shingle is one shingle. Rows without doc_id get a row and link others, but are no component_id
    unless the whole component has none (then it is null). Repeated rows are rows of their own. Empty table: no rows.
    """
    narrow = cut_lineage(fingerprints(docs.select(*[F.col(f"`{c}`").alias(f"_k{n}") for n, c in enumerate((id_col, *keep))],
                                                  F.col(f"`{text}`").alias("text")), "text", shingle, seed))
    least = cut_lineage(narrow.groupBy(F.col("_fp").alias("fp")).agg(F.min("_k0").alias("least")))
    roots = components(near_links(least.select("fp"), radius, part_rows))
    grouped = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = cut_lineage(grouped)
    ids = cut_lineage(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = cut_lineage(grouped.join(ids, "root").select("fp", "component_id"))
    return narrow.join(by_print, narrow._fp == by_print.fp).select(
        F.col("_k0").alias(id_col), *[F.col(f"_k{n}").alias(c) for n, c in enumerate(keep, 1)],
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs` with one document of each component: the one with the least doc_id.

    Of repeated rows with that doc_id one stays. Where no document of a component has a doc_id, one row of each
    fingerprint stays. The columns of `docs` travel in one struct, so their names can't clash.
    """
    marked = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn(
        "h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("empty", F.col("text").isNull())
    found = near_duplicates(marked, "id", "text", keep=("h", "empty"), **settings)
    # the first text, by hash, among the rows that carry the component's least doc_id
    chosen = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy(
        F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), "fingerprint")).alias("g")).agg(
        F.min(F.struct("empty", "h", "id")).alias("c"))
    chosen = chosen.select(F.col("c.id").alias("ci"), F.col("c.h").alias("ch"), F.col("c.empty").alias("ce"))
    kept = marked.join(chosen, F.col("id").eqNullSafe(F.col("ci")) & (F.col("h") == F.col("ch")) & (F.col("empty") == F.col("ce")))
    return kept.dropDuplicates(["ci", "ch", "ce"]).select("row.*")

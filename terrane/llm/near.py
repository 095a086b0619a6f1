"""Near copies by exact Jaccard similarity of word shingles.

Texts with the same set of shingles merge first, so a group of copies is one row. Candidates come from operator 8's
SimHash, sets whose fingerprints are linked within its radius being a bucket, and for what these bits miss from MinHash: a
set goes to BANDS more buckets, each named by ROWS of its least hashes. Only sets that share a bucket are compared. Buckets
with equal members count once. Large ones are cut into parts: each part is connected by itself, then only rows that
aren't connected by that are compared across every two parts, by a task for each. Links connect sets, so a group has
about as many as it has members. Shingles are fetched for sets with a candidate only. A link needs the exact
similarity of both sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from . import simhash
from .components import components
from .tokens import buffers, in_arrow, mixed, pieces, words

SHINGLE = 5
#: Least share of common shingles of near copies, as a fraction.
SHARE = (4, 5)
#: A pair at 0.8 has a bucket in common but for a chance of (1 - 0.8^4)^24 = 3e-6, a nearer one but for less.
BANDS, ROWS = 24, 4
#: Sets, and shingles, of one part of a bucket.
PART_ROWS, PART_SHINGLES = 1024, 1_000_000
_MULTIPLIERS = np.random.default_rng(42).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_STEPS = np.random.default_rng(43).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the distinct shingles of each text, and each row's offset.

    A shingle is `size` words that follow each other, in lower case (A-Z only); a text of fewer words, but not none,
    is one shingle.
    """
    found = words(*buffers(column))
    counts, row = np.diff(found.first), found.row
    codes = np.concatenate([found.codes, np.zeros(size, np.uint64)])
    place = np.arange(len(row)) - found.first[row]
    left = counts[row] - place
    start = np.flatnonzero((left >= size) | (place == 0))
    length, row = left[start], row[start]
    total = np.zeros(len(start), np.uint64)
    for k in range(size):
        total += np.where(k < length, codes[start + k], np.uint64(0)) * _STEPS[k]
    total = mixed(total)
    by = np.lexsort((total, row))
    total, row = total[by], row[by]
    new = np.ones(len(by), bool)
    new[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    return total[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def codes_of(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A code for each set, zero for the empty one."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def bands_of(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BANDS): the buckets of each set; of no use for empty sets."""
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k, multiplier in enumerate(_MULTIPLIERS):
            least = np.minimum.reduceat(codes * multiplier, offsets[:-1][full])
            band = k // ROWS
            out[full, band] = mixed(out[full, band] * np.uint64(3) + least + np.uint64(band))
    return out


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(id, h, empty, fp, n, bands, print) of (id, h, empty, text); `print` is the SimHash of the text."""
    schema = T.StructType([*docs.schema.fields[:3], T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("print", T.LongType())])

    def run(batches):
        for batch in batches:
            for low, high in pieces(batch.column(3)):
                texts = batch.column(3).slice(low, high - low)
                codes, offsets = shingles(texts, size)
                prints = np.fromiter((simhash.fingerprint(v.as_py() or b"") for v in texts.cast(pa.binary())), np.uint64, len(texts))
                n = np.diff(offsets)
                bands = bands_of(codes, offsets)[n > 0].ravel()
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).slice(low, high - low) for k in range(3)], pa.array(codes_of(codes, offsets).view(np.int64)),
                    pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.view(np.int64))), pa.array(prints.view(np.int64))], schema.names)

    return docs.transform(in_arrow, run, schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(fp, codes): the shingles of the texts of (text)."""

    def run(batches):
        for batch in batches:
            for low, high in pieces(batch.column(0)):
                codes, offsets = shingles(batch.column(0).slice(low, high - low), size)
                yield pa.RecordBatch.from_arrays([
                    pa.array(codes_of(codes, offsets).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(codes.view(np.int64)))], ["fp", "codes"])

    return docs.transform(in_arrow, run, "fp long, codes array<long>")


def linked(side: np.ndarray, sizes: np.ndarray, codes: np.ndarray, share: tuple[int, int] = SHARE,
           group: np.ndarray | None = None) -> tuple[list[int], list[int], np.ndarray]:
    """Pairs of rows that connect all rows with similar sets, and the least row that each row reaches over them.

    With rows of side 1, only side 0 is compared with side 1. Rows of one `group` are connected already and aren't
    compared. A row has one pair with each set of connected rows that it meets, so there are fewer pairs than rows.
    """
    n, two_sided = len(sizes), bool(side.any())
    ends = np.cumsum(sizes)
    heads = ends - sizes
    distinct, codes = np.unique(codes, return_inverse=True)
    mark = np.zeros(len(distinct), np.int64)
    label = np.arange(n)
    if group is not None:
        _, first, of = np.unique(group, return_index=True, return_inverse=True)
        label = first[of]
    left, right = [], []
    for i in range(n - 1):
        near = (label != label[i]) & (share[1] * np.minimum(sizes, sizes[i]) >= share[0] * np.maximum(sizes, sizes[i]))
        near[: i + 1] = False
        if two_sided:
            near &= side != side[i]
        others = np.flatnonzero(near)
        if not len(others):
            continue
        many = sizes[others]
        first = np.cumsum(many) - many
        at = np.repeat(heads[others] - first, many) + np.arange(many.sum())
        mark[codes[heads[i] : ends[i]]] = 1
        common = np.add.reduceat(mark[codes[at]], first)
        mark[codes[heads[i] : ends[i]]] = 0
        hits = others[(share[0] + share[1]) * common >= share[0] * (sizes[i] + many)]  # common / union >= share
        if len(hits):
            met, one = np.unique(label[hits], return_index=True)
            left.extend([i] * len(met))
            right.extend(hits[one].tolist())
            met = np.append(met, label[i])
            label[np.isin(label, met)] = met.min()
    return left, right, label


def _compared(cells: DataFrame, sets: DataFrame, share: tuple[int, int], every: bool) -> DataFrame:
    """Compare the rows (key, left, right, side, grp, fp) of each cell (key, left, right).

    With `every`, each row and the least row that it reaches in its cell: (key, part, a, b); else the links (a, b).
    """
    cell = ["key", "left", "right"]
    cells = cells.join(sets, "fp").select(*cell, "side", "fp", "grp", "codes").repartition(*cell).sortWithinPartitions(*cell, "side", "fp")
    names = ["key", "part", "a", "b"] if every else ["a", "b"]

    def run(batches):
        kept = None

        def finish(table, bounds):
            side, fp, group = (table.column(c).to_numpy() for c in ("side", "fp", "grp"))
            column = table.column("codes").combine_chunks()
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = column.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            a, b = [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                x, y, label = linked(side[low:high], sizes[low:high], codes[ends[low] : ends[high]], share, group[low:high])
                if every:
                    x, y = range(high - low), label
                a.append(fp[low:high][list(x)])
                b.append(fp[low:high][list(y)])
            out = [pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()) for c in ("key", "left")] + out if every else out, names)

        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch]).combine_chunks()
            edge = np.zeros(table.num_rows, bool)
            for c in cell:
                values = table.column(c).to_numpy()
                edge[1:] |= values[1:] != values[:-1]
            ends = np.flatnonzero(edge).tolist()
            if ends:
                yield from finish(table.slice(0, ends[-1]), [0, *ends])
                table = table.slice(ends[-1])
            kept = table
        if kept is not None and kept.num_rows:
            yield from finish(kept, [0, kept.num_rows])

    return cut_lineage(cells.transform(in_arrow, run, "key long, part int, a long, b long" if every else "a long, b long"))


def _across(labelled: DataFrame, found: DataFrame, sets: DataFrame, share: tuple[int, int], part_rows: int) -> DataFrame:
    """(a, b): links between the parts of large buckets, given what each row (key, part, a) reaches in its part, b.

    First one row of each connected set is compared with those of other parts, which ties together nearly all that
    belongs together. Then every row is compared with the rows of other parts that it isn't connected to by then; a
    row whose counterparts are all connected to it isn't sent.
    """
    large = cut_lineage(labelled.join(found.filter("parts > 1").select("key", "parts"), "key"))
    heads = large.filter("a = b").select("key", F.col("a").alias("fp"))
    shares = heads.groupBy("key").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("shares"))
    share_of = F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int")
    heads = heads.join(shares, "key").select("key", share_of.alias("left"), share_of.alias("right"), F.lit(0).alias("side"), F.col("fp").alias("grp"), "fp")
    tied = _compared(heads, sets, share, True).select("key", "a", "b")
    rows = large.join(tied.select("key", F.col("a").alias("b"), F.col("b").alias("grp")), ["key", "b"]).select("key", "part", "parts", F.col("a").alias("fp"), "grp")
    spans = rows.groupBy("key", F.col("part").alias("other")).agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> part").join(spans, ["key", "other"])
    sent = sent.filter("low <> high or low <> grp").select(
        "key", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), (F.col("part") > F.col("other")).cast("int").alias("side"), "grp", "fp")
    return tied.select("a", "b").filter("a <> b").unionByName(_compared(sent, sets, share, False))


def by_print(rows: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """(fp, n, key): the sets of (fp, n, print) by the fingerprints that operator 8 joins; all texts of a set count."""
    prints = cut_lineage(rows.filter("n > 0").select("fp", "n", "print").distinct())
    roots = components(simhash.near_links(prints.select(F.col("print").alias("fp")).distinct(), radius))
    joined = prints.join(roots, F.col("print") == F.col("node"), "left")
    return joined.select("fp", "n", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("key")).distinct()


def similar(sketches: DataFrame, docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = SHARE, part_rows: int = PART_ROWS,
            part_shingles: int = PART_SHINGLES, more: DataFrame | None = None) -> DataFrame:
    """(a, b): links between sets of `sketches` (fp, n, bands, c) that connect all with at least `share` in common.

    `c` tells the row (empty, id, h) of `docs` (id, h, empty, text) that has the text of the set; `more` (fp, n, key) are
    buckets beside those of the bands.
    """
    entries = sketches.filter("n > 0").select("fp", "n", F.explode("bands").alias("key"))
    entries = entries if more is None else entries.unionByName(more)
    found = entries.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("fp")).alias("members")).filter("rows > 1")
    # near copies meet in most of their buckets; those with equal members are one
    found = found.groupBy("rows", "total", "members").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.greatest(F.col("rows") / part_rows, F.col("total") / part_shingles)).cast("int").alias("parts"))
    found = cut_lineage(found)
    rows = cut_lineage(entries.select("fp", "key").join(found, "key"))
    wanted = cut_lineage(sketches.join(rows.select("fp").distinct(), "fp", "left_semi").select("c.*"))
    wanted = wanted.select(*[F.col(c).alias(f"_{c}") for c in ("id", "h")])
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("text")
    sets = cut_lineage(_sets(texts, size)).dropDuplicates(["fp"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = rows.select("key", part.alias("left"), part.alias("right"), F.lit(0).alias("side"), F.col("fp").alias("grp"), "fp")
    labelled = _compared(dealt, sets, share, True)
    within = labelled.select("a", "b").filter("a <> b")
    # buckets of one part, all but the largest, are done
    return within.unionByName(_across(labelled, found, sets, share, part_rows)) if found.filter("parts > 1").limit(1).count() else within


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, share: tuple[int, int] = SHARE,
                 part_rows: int = PART_ROWS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """`docs` with one row of each group of near copies: the one with the least doc_id, of those the least hash of text.

    Two texts are near copies if their distinct shingles have a Jaccard similarity of at least `share`; groups are
    joined over such links. Null and empty texts and texts of blanks are copies of each other. A row without doc_id
    stays only if its whole group has none. Ids that repeat over unrelated texts do no harm. Empty table: no rows. The
    columns of `docs` travel in one struct, so their names can't clash.
    """
    marked = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn(
        "h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("empty", F.col("text").isNull())
    narrow = marked.select("id", "h", "empty", "text")
    rows = cut_lineage(_sketches(narrow, size))
    # the row that stands for a set: with an id, the least; texts before nulls
    sketches = cut_lineage(rows.groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "empty", "h")).alias("c"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    roots = components(similar(sketches, narrow, size, share, part_rows, part_shingles, cut_lineage(by_print(rows))))
    chosen = sketches.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("g")).agg(F.min("c").alias("c"))
    chosen = cut_lineage(chosen.select("g", F.col("c.id").alias("ci"), F.col("c.h").alias("ch"), F.col("c.empty").alias("ce")))
    kept = marked.join(chosen, F.col("id").eqNullSafe(F.col("ci")) & (F.col("h") == F.col("ch")) & (F.col("empty") == F.col("ce")))
    return kept.dropDuplicates(["g"]).select("row.*")

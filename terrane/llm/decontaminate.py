"""Benchmark decontamination with suffix arrays over the training texts.

Each task takes the documents of its partition in pieces of about a megabyte. For a piece it builds a suffix array
over words and looks up every suffix of every benchmark item by binary search; the range found gives all places
where the item's next words stand verbatim. The array is sparse: it holds the suffixes whose first two words follow
each other in some item (or whose first word is an item of one word), as no other can match. Documents never move.
The benchmark is given as a query set and sent to the tasks in blocks of bounded size, one search of the texts of a
partition for each block. A benchmark beyond the bound of one call is dealt out by hash and searched in passes: each
leaves the matches by hash of text, and the last one, which gives the rows, unites them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from .tokens import buffers, in_arrow, mixed, pieces, words

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Characters of benchmark text in one block that is sent to the tasks, and in all blocks of a call: a word takes some
#: 170 bytes in a worker. A larger benchmark is an error of `matches`; `matches_in_passes` makes the calls that it takes.
BLOCK_CHARACTERS = 2_000_000
MOST_CHARACTERS = 40_000_000
#: Characters of benchmark text of one pass; a longer item has a pass of its own or shares one.
PASS_CHARACTERS = 10_000_000

_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())])


def _keys(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` words from each place as one byte string; byte order is the order of the suffix array."""
    return _as_keys(codes[at[:, None] + np.arange(depth)])


def _as_keys(grid: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grid.astype(">u8")).view(f"S{8 * grid.shape[1]}").ravel() if len(grid) else np.zeros(0, f"S{8 * grid.shape[1]}")


@dataclass
class Suffixes:
    """Suffixes of a block of benchmark items: keys, lengths in words (up to a window), item numbers and places in the item."""

    names: list[str]
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    item: np.ndarray
    place: np.ndarray
    pairs: np.ndarray
    singles: np.ndarray


def _pair_codes(codes: np.ndarray) -> np.ndarray:
    return mixed(codes[:-1] * np.uint64(3) + codes[1:])


def suffixes(names: list[str], texts: list[str], window: int) -> Suffixes:
    """Every window of every item as the search keys of a block."""
    found = words(*buffers(pa.array(texts, pa.string())), alnum=True)
    counts = np.diff(found.first)
    codes = np.concatenate([found.codes, np.zeros(window, np.uint64)])
    row = found.row
    place = np.arange(len(row)) - found.first[row]
    left = counts[row] - place
    start = np.flatnonzero((left >= window) | (place == 0))
    length = np.minimum(left[start], window)
    grid = codes[start[:, None] + np.arange(window)]
    beyond = np.arange(window) >= length[:, None]
    same = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    return Suffixes(names, _as_keys(np.where(beyond, np.uint64(0), grid)), _as_keys(np.where(beyond, np.uint64(2**64 - 1), grid)), length, row[start], place[start],
                    np.unique(_pair_codes(found.codes)[same]) if len(row) > 1 else np.zeros(0, np.uint64),
                    np.unique(found.codes[start[length == 1]]))


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def search(column: pa.Array, query: Suffixes, window: int) -> tuple[np.ndarray, list[list[list[int]]], list[list[str]], np.ndarray]:
    """Words, spans of hit words, items found and longest match of each text of a piece."""
    n = len(column)
    found = words(*buffers(column), alnum=True)
    counts = np.diff(found.first)
    gap = np.arange(n) * window  # so many empty words stand between texts, so no suffix reads into the next
    at = np.arange(len(found.codes)) + gap[found.row]
    codes = np.zeros(len(found.codes) + (n + 1) * window, np.uint64)
    codes[at] = found.codes
    fits = _within(_pair_codes(codes)[at], query.pairs) | _within(codes[at], query.singles)
    array = at[fits]
    keys = _keys(codes, array, window)
    order = np.argsort(keys, kind="stable")
    array, keys = array[order], keys[order]
    low, high = np.searchsorted(keys, query.low, "left"), np.searchsorted(keys, query.high, "right")
    many = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(many)), many)
    places = array[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    heads = found.first[:-1] + gap
    doc = np.searchsorted(heads, places, "right") - 1
    spans: list[list[list[int]]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    longest = np.zeros(n, np.int64)
    if len(places):
        # matches of one item that lie on one diagonal and follow each other are one longer match
        item, diagonal = query.item[which], places - query.place[which]
        by = np.lexsort((places, diagonal, item))
        p, d, i, size = places[by], diagonal[by], item[by], query.length[which][by]
        new = np.ones(len(by), bool)
        new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(by)) - 1
        begin, end = p[first], p[last] + size[last]
        np.maximum.at(longest, doc[by][first], end - begin)
        for k in np.unique(doc * np.int64(len(query.names)) + item):
            items[k // len(query.names)].append(query.names[k % len(query.names)])
        steps = np.zeros(len(codes) + 1, np.int64)
        np.add.at(steps, begin, 1)
        np.add.at(steps, end, -1)
        edge = np.diff(np.concatenate([[False], np.cumsum(steps) > 0]).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            k = int(np.searchsorted(heads, a, "right") - 1)
            spans[k].append([int(a - heads[k]), int(b - heads[k])])
    return counts, spans, items, longest


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_characters: int, most: float) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark's items in blocks of at most `block_characters` characters, read row by row."""
    names: list[str] = []
    texts: list[str] = []
    size = total = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).filter(F.col(text_col).isNotNull())
    for name, text in rows.toLocalIterator():
        if texts and size + len(text) > block_characters:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(name)
        texts.append(text)
        size += len(text)
        total += len(text)
        if total > most:
            raise ValueError(f"a benchmark of more than {most} characters must be searched in several calls")
    if texts:
        yield names, texts


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            window: int = WINDOW, block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """`docs` with a column `_found`: its words, the spans of words hit, the items found and the longest match.

    A word is a run of letters, digits and non-ASCII characters in lower case (A-Z only). A window is `window` words
    of an item that follow each other; an item of fewer words, but not none, is one window. `spans` are disjoint
    [begin, end) in words, `items` names without repeats as strings, `longest` the most words in a row that stand so
    in an item.

    Null text: no words, nothing found. Empty text and texts shorter than every item: nothing found. Items that are
    null or have no word are never found; repeated items are found under each of their ids, a null id under the
    empty string. Empty tables: no rows, or nothing found. Other columns pass through; a column `_found` of `docs`
    is replaced.
    """
    docs = docs.drop("_found")
    return _searched(docs, _sent(docs, benchmark, item_id, item_text, window, block_characters, MOST_CHARACTERS), text, window)


def _sent(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int, block_characters: int, most: float) -> list:
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(suffixes(n, t, window)) for n, t in _blocks(benchmark, item_id, item_text, block_characters, most)]
    return blocks or [sc.broadcast(suffixes([], [], window))]


def _searched(docs: DataFrame, blocks: list, text: str, window: int, before: str | None = None) -> DataFrame:
    """`docs` with `_found` in the place of the column `before`, the matches of earlier passes."""
    names = [c for c in docs.columns if c != before]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("_found", _FOUND)])
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
    place = names.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            earlier = batch.column(len(names)) if before else None
            counts, spans, items, longest = [], [], [], []
            for low, high in pieces(column):
                piece = column.slice(low, high - low)
                total, all_spans, all_items, best = None, None, None, None
                for block in blocks:
                    c, s, i, b = search(piece, block.value, window)
                    if total is None:
                        total, all_spans, all_items, best = c, s, i, b
                    else:
                        best = np.maximum(best, b)
                        all_spans = [_united(x, y) for x, y in zip(all_spans, s, strict=True)]
                        all_items = [sorted({*x, *y}) for x, y in zip(all_items, i, strict=True)]
                for k, old in enumerate(earlier.slice(low, high - low).to_pylist() if before else ()):
                    for one in old or ():
                        all_spans[k] = _united(all_spans[k], one["spans"])
                        all_items[k] = [*all_items[k], *one["items"]]
                        best[k] = max(best[k], one["longest"])
                counts.extend(total.tolist())
                spans.extend(all_spans)
                items.extend(sorted(set(x)) for x in all_items)
                longest.extend(best.tolist())
            found = pa.array([dict(n_words=c, spans=s, items=i, longest=b) for c, s, i, b in zip(counts, spans, items, longest, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], found], [*names, "_found"])

    return docs.transform(in_arrow, run, schema)


def matches_in_passes(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      window: int = WINDOW, block_characters: int = BLOCK_CHARACTERS, pass_characters: int | None = None) -> DataFrame:
    """What `matches` gives, for a benchmark of any size: more text means more passes over `docs`.

    The items of a pass are broadcast together and dropped when it is done; texts are found again by two hashes.
    """
    benchmark = benchmark.filter(F.col(item_text).isNotNull())
    size = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    passes = max(1, math.ceil(size / (pass_characters or PASS_CHARACTERS)))
    docs = docs.drop("_found")
    if passes == 1:
        return _searched(docs, _sent(docs, benchmark, item_id, item_text, window, block_characters, math.inf), text, window)
    turn = F.pmod(F.xxhash64(item_id, item_text), F.lit(passes))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    hits = None
    for k in range(passes - 1):
        blocks = _sent(docs, benchmark.filter(turn == k), item_id, item_text, window, block_characters, math.inf)
        found = _searched(docs.select(F.col(text).alias("text")), blocks, "text", window).filter(F.size("_found.spans") > 0)
        found = cut_lineage(found.select(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), "_found").dropDuplicates(["a", "b"]))
        hits = found if hits is None else hits.unionByName(found)
        for block in blocks:
            block.destroy()
    hits = cut_lineage(hits.groupBy("a", "b").agg(F.collect_list("_found").alias("before")))  # one for each pass at most
    hits = hits.select(F.struct("a", "b").alias("_key"), F.col("before").alias("_before"))
    packed = docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_text"), key.alias("_of")).join(hits, F.col("_of") == F.col("_key"), "left")
    last = _sent(docs, benchmark.filter(turn == passes - 1), item_id, item_text, window, block_characters, math.inf)
    done = _searched(packed.select("_row", "_text", "_before"), last, "_text", window, "_before")
    return done.select(*[F.col("_row")[c].alias(c) for c in docs.columns], "_found")


def _united(x: list[list[int]], y: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted([*x, *y]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def hit_words(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents of which no word lies in a window of the benchmark, with the columns of `docs`."""
    found = matches_in_passes(docs, benchmark, **settings)
    return found.filter(F.size("_found.spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

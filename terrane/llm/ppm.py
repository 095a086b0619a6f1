"""Language-model scores by prediction by partial matching, and a word model as the base line.

Training counts all runs of six bytes (a context of five and the byte after it) and all words; every counted run is in
the trie, whatever its share. A byte is looked for in its longest known context; if it isn't there the model escapes
to the next shorter one (method C: the escape weighs as much as the context has branches) and leaves out the bytes
that the longer context already offered (symbol exclusion). The cost of a byte depends on six bytes only, so each
distinct run of the corpus is priced once. For that the runs are dealt by the last three bytes of their context, which
brings all longer contexts of a run into one task; shorter contexts are the same for all tasks and are sent to them.
The prices of frequent runs go to the tasks that read the texts, the others are joined to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from .tokens import LOWER, buffers, in_arrow, pieces, row_sums, words

#: Longest context in bytes.
ORDER = 5
#: Levels that are sent to the tasks. Lower-cased UTF-8 has less than five million different runs of three bytes.
SHARED_ORDERS = 3
#: Prices of runs and words that make up at least one in so many of all are sent to the tasks, the others are joined.
#: Results don't depend on it.
SHARE = 1 << 21
#: Bytes that UTF-8 never has: before the first byte of a text, and as its end.
BEFORE, END = 0xFE, 0xFF
#: The code of the end of a text among the words.
END_WORD = np.uint64(0)
GRAM, WORD = 0, 1
_HELD = 4_000_000
_PRICED = 500_000


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The run of ORDER + 1 bytes that ends at each byte, and at the end, of each text; and each row's offset."""
    data, offsets = buffers(column)
    rows = len(offsets) - 1
    padded = np.full(len(data) + rows * (ORDER + 1), BEFORE, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    at = np.arange(len(data)) + row * (ORDER + 1) + ORDER
    padded[at] = LOWER[data]
    ends = offsets[1:] + np.arange(rows) * (ORDER + 1) + ORDER
    padded[ends] = END
    symbol = np.zeros(len(padded), bool)
    symbol[at] = True
    symbol[ends] = True
    key = np.zeros(len(padded), np.uint64)
    for k in range(ORDER + 1):
        key[ORDER:] = (key[ORDER:] << np.uint64(8)) | padded[k : len(padded) - ORDER + k]
    return key[symbol], offsets + np.arange(rows + 1)


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of each text, each text closed by the end; and each row's offset."""
    found = words(*buffers(column))
    rows = len(found.first) - 1
    codes = np.full(len(found.codes) + rows, END_WORD, np.uint64)
    codes[np.arange(len(found.codes)) + found.row] = found.codes
    return codes, found.first + np.arange(rows + 1)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, where = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(where, n, len(keys)).astype(np.int64) for n in counts)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n, times) of the rows (text, whether to learn from it): how often each run of bytes and each word
    stands in the texts to learn from, and in all."""

    def rows_of(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(columns[0]), 200_000):
            keys, n, times = (c[k : k + 200_000].view(np.int64) for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n), pa.array(times)], ["kind", "key", "n", "times"])

    def run(batches):
        held: dict[int, list] = {GRAM: [], WORD: []}
        for batch in batches:
            learnt = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for low, high in pieces(batch.column(0), 1 << 21):
                piece = batch.column(0).slice(low, high - low)
                for kind, (codes, offsets) in ((GRAM, grams(piece)), (WORD, text_words(piece))):
                    keys, where, times = np.unique(codes, return_inverse=True, return_counts=True)
                    n = np.bincount(where[np.repeat(learnt[low:high], np.diff(offsets))], minlength=len(keys))
                    held[kind].append((keys, n.astype(np.int64), times.astype(np.int64)))
                    if sum(len(part[0]) for part in held[kind]) > _HELD // 4:
                        held[kind] = [_added(held[kind])]
                        if len(held[kind][0][0]) > _HELD:  # a task holds so many distinct keys; then it hands them on
                            yield from rows_of(kind, *held[kind][0])
                            held[kind] = []
        for kind, parts in held.items():
            if parts:
                yield from rows_of(kind, *_added(parts))

    rows = texts.transform(in_arrow, run, "kind int, key long, n long, times long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


@dataclass
class Level:
    """One context length: branches by key with their counts, and contexts by key with their statistics."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    whole: np.ndarray  # count of the context
    branches: np.ndarray
    excluded: np.ndarray  # count of the same branches one length shorter


def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def level(keys: np.ndarray, counts: np.ndarray, shorter: Level | None, order: int) -> Level:
    """The contexts of `order` bytes from runs that end with one of them and the byte after it."""
    keys, where = np.unique(keys & np.uint64((1 << (8 * order + 8)) - 1), return_inverse=True)
    counts = np.bincount(where, counts, len(keys))
    contexts, first, n = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
    whole, excluded = np.zeros(len(contexts)), np.zeros(len(contexts))
    if len(first):
        whole = np.add.reduceat(counts, first)
        if shorter is not None:
            at, found = _find(shorter.keys, keys & np.uint64((1 << (8 * order)) - 1))
            excluded = np.add.reduceat(np.where(found, shorter.counts[at], 0.0), first)
    return Level(keys, counts, contexts, whole, n.astype(float), excluded)


@dataclass
class Trie:
    levels: list[Level]

    def log10(self, runs: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each run after the bytes before it."""
        total = np.zeros(len(runs))
        open_ = np.ones(len(runs), bool)
        gone, gone_branches = np.zeros(len(runs)), np.zeros(len(runs))  # of the context escaped from, at this length
        for order in range(len(self.levels) - 1, -1, -1):
            lv = self.levels[order]
            key = runs & np.uint64((1 << (8 * order + 8)) - 1)
            context, known = _find(lv.contexts, key >> np.uint64(8))
            branch, there = _find(lv.keys, key)
            if not len(lv.contexts):
                continue
            escape = lv.branches[context] - gone_branches
            below = lv.whole[context] - gone + escape
            use = open_ & known & (below > 0)
            hit = use & there
            total[hit] += np.log10(lv.counts[branch[hit]] / below[hit])
            open_ &= ~hit
            miss = use & ~there
            total[miss] += np.log10(escape[miss] / below[miss])
            on = open_ & known
            gone, gone_branches = np.where(on, lv.excluded[context], 0.0), np.where(on, lv.branches[context], 0.0)
        total[open_] -= np.log10(256 - gone_branches[open_])
        return total


def shared_levels(counts: DataFrame) -> list[Level]:
    """The levels of the shortest contexts, summed from the counted runs (key, n)."""
    levels: list[Level] = []
    runs = counts.groupBy(F.col("key").bitwiseAND((1 << (8 * SHARED_ORDERS)) - 1).alias("key")).agg(F.sum("n").alias("n")).toPandas()
    for order in range(SHARED_ORDERS):
        levels.append(level(runs.key.to_numpy().astype(np.uint64), runs.n.to_numpy().astype(float), levels[-1] if levels else None, order))
    return levels


def run_prices(counts: DataFrame) -> DataFrame:
    """(key, price, times) of the runs (key, n, times): the log10 probability of the last byte of each.

    Runs with n = 0 are priced, but not learned from. A group of runs with the same last three bytes of context is
    decided at once; it has at most 2^24 runs, whatever the size of the corpus.
    """
    shared = counts.sparkSession.sparkContext.broadcast(shared_levels(counts.filter("n > 0").select("key", "n")))
    group = F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFFFF)

    def priced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys, n = table["key"].to_numpy().astype(np.uint64), table["n"].to_numpy()
        levels = list(shared.value)
        for order in range(SHARED_ORDERS, ORDER + 1):
            levels.append(level(keys[n > 0], n[n > 0], levels[-1], order))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(Trie(levels).log10(keys)), pa.array(table["times"].to_numpy())], ["key", "price", "times"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < _PRICED:
                continue
            # the last group may go on in the next batch
            groups = np.concatenate([b.column(0).to_numpy() for b in held])
            whole = int(np.searchsorted(groups, groups[-1]))
            if whole:
                table = pa.Table.from_batches(held)
                yield priced(table.slice(0, whole).to_batches())
                held = table.slice(whole).to_batches()
        if held and sum(map(len, held)):
            yield priced(held)

    dealt = counts.select(group.alias("last"), "key", "n", "times").repartition("last").sortWithinPartitions("last")
    return dealt.transform(in_arrow, run, "key long, price double, times long")


def _head(prices: DataFrame, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and prices of the rows (key, price, times) with at least one in `share` of all times."""
    total = prices.agg(F.sum("times")).first()[0] or 0
    often = prices.filter(F.col("times") * share >= total).select("key", "price").toPandas()
    keys = often.key.to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], often.price.to_numpy().astype(float)[by]


def scored(docs: DataFrame, id_col: str = "doc_id", text: str = "text", train: Column | None = None, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows that satisfy `train` (all by default). Texts are lower-cased in A-Z. score is the log10
    probability of the bytes of the text and its end under the trie. base_score sums log10((c + 0.1) / (N + 0.1 (V +
    1))) over the words and the end, c being a word's count, N all and V the distinct words in training; n_known are
    those with c > 0. Frequent runs and words are priced in the tasks, all others by a join on their code.

    Null and empty texts: the end alone. Null doc_id and repeated rows: each row counts and gets its scores. Nothing to
    learn from: every byte has probability 1/256, every word 1. Empty table: no rows.
    """
    sc = docs.sparkSession.sparkContext
    learnt = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    counts = cut_lineage(corpus_counts(docs.select(F.col(f"`{text}`").alias("text"), learnt.alias("learnt"))))
    vocabulary = counts.filter(F.col("kind") == WORD)
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    below = size.n + 0.1 * (size.v + 1)
    word_prices = vocabulary.select("key", F.log10((F.col("n") + 0.1) / below).alias("price"), "times")
    gram_prices = run_prices(counts.filter(F.col("kind") == GRAM).select("key", "n", "times"))
    prices = cut_lineage(gram_prices.withColumn("kind", F.lit(GRAM)).unionByName(word_prices.withColumn("kind", F.lit(WORD))))
    known_from = float(np.log10(0.5 / below))  # between the prices of a word never learned and one learned once
    heads = sc.broadcast([_head(prices.filter(F.col("kind") == k), share) for k in (GRAM, WORD)])
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    left = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([narrow.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
                           T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()), T.StructField("rare", left)])

    def run(batches):
        for batch in batches:
            for low, high in pieces(batch.column(1)):
                piece, rows = batch.column(1).slice(low, high - low), high - low
                columns, rare = [], []
                for kind, (codes, offsets) in ((GRAM, grams(piece)), (WORD, text_words(piece))):
                    keys, price = heads.value[kind]
                    distinct, where = np.unique(codes, return_inverse=True)
                    at, found = _find(keys, distinct)
                    cost = np.where(found, price[at], 0.0) if len(price) else np.zeros(len(distinct))
                    if kind == WORD:
                        columns += [np.diff(offsets), row_sums((found & (cost > known_from))[where], offsets)]
                    columns.append(row_sums(cost[where], offsets).astype(float))
                    open_ = ~found[where]
                    row = np.repeat(np.arange(rows), np.diff(offsets))
                    pair, n = np.unique(row[open_] * np.int64(len(distinct)) + where[open_], return_counts=True)
                    rare.append((pair // max(1, len(distinct)), np.full(len(pair), kind, np.int32), distinct[pair % max(1, len(distinct))].view(np.int64), n.astype(np.int64)))
                of, *values = (np.concatenate(x) for x in zip(*rare, strict=True))
                by = np.argsort(of, kind="stable")
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(v[by]) for v in values], ["kind", "key", "n"]))
                model, tokens, known, base = columns
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, rows), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)),
                                                  pa.array(base), pa.array(model), lists], schema.names)

    rows = cut_lineage(narrow.transform(in_arrow, run, schema)).withColumn("row", F.monotonically_increasing_id())
    # what is left to the join is less than one in 2^21 of all, so no key is hot
    single = rows.select("row", F.explode("rare").alias("r")).select("row", F.col("r.kind").alias("kind"), F.col("r.key").alias("key"), F.col("r.n").alias("n"))
    word = F.col("kind") == WORD
    priced = single.join(prices.drop("times"), ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(word, F.col("n") * F.col("price")).otherwise(0.0)).alias("rest"),
        F.sum(F.when(word, 0.0).otherwise(F.col("n") * F.col("price"))).alias("bytes"),
        F.sum(F.when(word & (F.col("price") > known_from), F.col("n")).otherwise(0)).alias("more"))
    return rows.drop("rare").join(priced, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(size.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("bytes", F.lit(0.0))).alias("score"))

"""Full-text search over a table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, stem, tokens
from ..session import BROADCAST_ROWS, broadcast_up_to, cut_lineage

# The ranking constants of the usual BM25.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
_PREFIX = 12
#: Words of which a task makes postings at a time.
BATCH_WORDS = 1_000_000
#: Hits of one task that sums up scores.
PART_HITS = 500_000
#: Postings or hits that a task packs at a time.
PACK_ROWS = 200_000
#: Texts, and their characters, of a block that is compared with another; meetings of two blocks in a task.
BLOCK_TEXTS, BLOCK_CHARS, TASK_BLOCKS = 2_048, 1_000_000, 4


def build_index(docs: DataFrame, *columns: str) -> DataFrame:
    """Inverted index `term, doc, tf, length, positions` of the given text columns, the document key being `doc`.

    Words are numbered over the columns with a gap between two of them, so no phrase runs from one into the next. Texts
    are folded and cut once; words are sorted and counted row by row inside a batch, so neither texts nor postings are shuffled.
    """
    parts = docs.select("doc", F.array(*[tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns]).alias("parts"))
    words = parts.select("doc", F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.array(F.lit("")), p)))).alias("words"))
    schema = T.StructType([T.StructField("term", T.StringType()), docs.schema["doc"], T.StructField("tf", T.LongType()),
                           T.StructField("length", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return words.mapInArrow(_postings, schema)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (doc, words); an empty word is a gap, which takes a place but is no word."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:  # rows of BATCH_WORDS words at a time, one row at least
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + BATCH_WORDS, "right")))
            yield _counted(batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low))
            low = high


def _counted(doc: pa.Array, words: pa.Array) -> pa.RecordBatch:
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = words.flatten().dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    word = np.append(pc.not_equal(known, "").to_numpy(zero_copy_only=False), False)[code]
    row, place, code = row[word], place[word], code[word]
    lengths = np.bincount(row, minlength=len(sizes))
    key = row * (len(known) + 1) + code
    by = np.argsort(key, kind="stable")
    key = key[by]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    first = by[heads]
    offsets = np.append(heads, len(key)).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[by].astype(np.int32)))
    return pa.RecordBatch.from_arrays([
        known.take(pa.array(code[first])), doc.take(pa.array(row[first])), pa.array(np.diff(offsets).astype(np.int64)),
        pa.array(lengths[row[first]].astype(np.int32)), positions], ["term", "doc", "tf", "length", "positions"])


def corpus_statistics(index: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length in tokens, without reading the texts again."""
    count = docs.select(F.count(F.lit(1))).scalar()
    return index.agg(count.alias("docs"), (F.sum("tf") / count).alias("mean_length"))


def query_terms(queries: DataFrame, singular: bool = True) -> DataFrame:
    """`query_id, q_term`: distinct folded words, a plural `s` dropped.

    A word with other characters between its letters, such as `brand_12_7`, is a phrase: its parts, joined by blanks, must stand
    side by side. Only the last part of a term may be the beginning of a longer word.
    """
    words = queries.select("query_id", F.explode(F.split(fold(F.col("query")), r"[\s\p{Z}]+")).alias("w"))
    parts = F.array_remove(F.split(stem(F.col("w")) if singular else F.col("w"), r"[^\p{L}\p{N}]+"), "")
    return words.select("query_id", F.array_join(parts, " ").alias("q_term")).where("q_term <> ''").distinct()


def _matching_words(index: DataFrame, parts: DataFrame) -> DataFrame:
    """`term, part, last`: words of the index that equal a part, or begin with it where it is the last of its phrase.

    The vocabulary is matched first: each word is listed under its prefixes, so
    that the prefix test becomes an equality. The matching words are written,
    which gives the planner their size: while small they are broadcast to the
    postings, which then stay where they are.
    """
    words = index.select("term").distinct()
    asked = parts.select("part", "last").distinct()
    begun = asked.where("last").withColumn("prefix", F.left("part", F.lit(_PREFIX)))
    # At most twelve prefix lengths occur; a word is listed under those only.
    lengths = begun.select(F.array_sort(F.collect_set(F.length("prefix")))).scalar()
    listed = words.select("term", F.explode(lengths).alias("n")).where(
        F.length("term") >= F.col("n")).select("term", F.expr("left(term, n)").alias("prefix"))
    longer = listed.join(begun, "prefix").where(F.col("term").startswith(F.col("part"))).select("term", "part", "last")
    whole = words.join(asked.where("not last").withColumn("term", F.col("part")), "term").select("term", "part", "last")
    return cut_lineage(longer.unionByName(whole))


def coded_terms(queries: DataFrame, singular: bool = True) -> tuple[DataFrame, DataFrame]:
    """The distinct query terms as `q_term, code`, and the queries as `query_id, code`; both are written."""
    q_terms = cut_lineage(query_terms(queries, singular))
    asked = cut_lineage(q_terms.select("q_term").distinct().withColumn("code", F.monotonically_increasing_id()))
    return asked, cut_lineage(q_terms.join(asked, "q_term").select("query_id", "code"))


_HITS = ("codes", "tfs", "lengths")
_PLACES = ("p_codes", "p_ns", "p_ks", "p_starts", "p_lengths")


def _hits_type(doc: T.StructField, *columns: str) -> T.StructType:
    return T.StructType([doc, *[T.StructField(c, T.ArrayType(T.LongType())) for c in columns]])


def term_hits(index: DataFrame, asked: DataFrame) -> DataFrame:
    """`doc, codes, tfs, lengths`: for each document the query terms it has, how often, and its length.

    A query term finds the words that equal it or begin with it. The parts of a phrase are found one by one; where all of
    them agree on the place at which the phrase would begin, it stands. Postings are matched where they lie, as long as the
    parts asked for can be sent to the tasks, and what a task finds of a document goes to the shuffle as one row. The hits
    are written, since document frequencies and scores both read them.
    """
    parts = asked.select("code", F.split("q_term", " ").alias("parts")).select(
        "code", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part")).withColumn("last", F.col("k") == F.col("n") - 1)
    parts = cut_lineage(parts)
    rows = parts.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        found = index.select("term", "doc", "tf", "length", "positions" if any(r.n > 1 for r in rows) else F.array().cast("array<int>").alias("positions"))
        find = partial(_matched, _Asked(rows))
    else:
        found = index.join(_matching_words(index, parts), "term").join(parts, ["part", "last"]).select(
            "code", "n", "k", "doc", "tf", "length", F.when(F.col("n") > 1, F.col("positions")).otherwise(F.array().cast("array<int>")).alias("positions"))
        find = _found
    packed = found.mapInArrow(find, _hits_type(index.schema["doc"], *_HITS, *_PLACES))
    least = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(packed.repartition(least, "doc").sortWithinPartitions("doc").mapInArrow(_merged, _hits_type(index.schema["doc"], *_HITS)))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, `counts` of them, and which start each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts), owner


class _Asked:
    """The parts of the query terms, by length, and the terms `code, n` in which a part has place `k`."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: (r.part, r.last))
        texts = list(dict.fromkeys((r.part, r.last) for r in rows))
        at = {key: k for k, key in enumerate(texts)}
        self.code, self.n, self.k = (np.array([r[c] for r in rows], np.int64) for c in ("code", "n", "k"))
        self.first = np.searchsorted([at[r.part, r.last] for r in rows], np.arange(len(texts) + 1))
        self.begun: dict[int, tuple[list[str], list[int]]] = {}
        self.whole: tuple[list[str], list[int]] = ([], [])
        for key, k in at.items():
            own = self.begun.setdefault(len(key[0]), ([], [])) if key[1] else self.whole
            own[0].append(key[0])
            own[1].append(k)

    def found_in(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word where its rows begin and how many it has, and in which place of `code`, `n` and `k` each row is."""
        longest = pc.max(pc.utf8_length(words)).as_py() or 0
        tests = [(pc.utf8_slice_codeunits(words, 0, size), own) for size, own in self.begun.items() if size <= longest]
        word, text = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shown, (some, places) in [*tests, *([(words, self.whole)] if self.whole[0] else [])]:
            met = pc.index_in(shown, value_set=pa.array(some, pa.string()))
            hit = np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False))
            word.append(hit)
            text.append(np.array(places, np.int64)[met.take(pa.array(hit)).to_numpy()])
        word, text = np.concatenate(word), np.concatenate(text)
        at, owner = _ranges(self.first[text], self.first[text + 1] - self.first[text])
        by = np.argsort(word[owner], kind="stable")
        counts = np.bincount(word[owner], minlength=len(words))
        return np.cumsum(counts) - counts, counts, at[by]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about PACK_ROWS at a time, one batch at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.array([], column.type) if not column.num_chunks else column.combine_chunks()


def _matched(asked: _Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings `term, doc, tf, length, positions` to one row for each document that has some of the terms."""
    for table in _gathered(batches):
        coded = _column(table, "term").dictionary_encode()
        starts, counts, at = asked.found_in(coded.dictionary)
        word = coded.indices.to_numpy()
        rows, posting = _ranges(starts[word], counts[word])
        yield _from_rows(table, posting, asked.code[at[rows]], asked.n[at[rows]], asked.k[at[rows]])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows `code, n, k, doc, tf, length, positions` to one row for each document."""
    for table in _gathered(batches):
        code, n, k = (_column(table, c).to_numpy().astype(np.int64) for c in ("code", "n", "k"))
        yield _from_rows(table, np.arange(len(code)), code, n, k)


def _from_rows(table: pa.Table, row: np.ndarray, code: np.ndarray, n: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    """Terms `code, n` met in a `row` of the table by their part `k`."""
    docs = _column(table, "doc").dictionary_encode(null_encoding="encode")
    doc, tf, length = docs.indices.to_numpy().astype(np.int64), *(_column(table, c).to_numpy().astype(np.int64) for c in ("tf", "length"))
    one, many = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
    positions = _column(table, "positions")
    at, owner = _ranges(positions.offsets.to_numpy().astype(np.int64)[row[many]], pc.list_value_length(positions).to_numpy(zero_copy_only=False)[row[many]])
    many = many[owner]
    places = positions.values.to_numpy().astype(np.int64)[at] - k[many]
    return _packed(docs.dictionary, (doc[row[one]], code[one], tf[row[one]], length[row[one]]),
                   (doc[row[many]], code[many], n[many], k[many], places, length[row[many]]))


def _listed(docs: pa.Array, owner: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """One list for each document of the values, sorted by their owner."""
    offsets = pa.array(np.searchsorted(owner, np.arange(len(docs) + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _packed(docs: pa.Array, hits: tuple[np.ndarray, ...], places: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """One row for each document: its hits by term, the frequencies added up, and the distinct places of parts of phrases."""
    by = np.lexsort(hits[1::-1])
    doc, code, tf, length = (v[by] for v in hits)
    heads = _runs(doc, code)
    by = np.lexsort((places[3], places[4], places[1], places[0]))
    p_doc, p_code, p_n, p_k, p_start, p_length = (v[by] for v in places)
    p_heads = _runs(p_doc, p_code, p_start, p_k)
    return pa.RecordBatch.from_arrays(
        [docs, *_listed(docs, doc[heads], code[heads], np.add.reduceat(tf, heads) if len(heads) else tf, length[heads]),
         *_listed(docs, p_doc[p_heads], *(v[p_heads] for v in (p_code, p_n, p_k, p_start, p_length)))], ["doc", *_HITS, *_PLACES])


def _flat(batch: pa.RecordBatch, columns: tuple[str, ...], before: int = 0) -> list[np.ndarray]:
    """The values of lists, and before them the row of each, counted from `before` on."""
    sizes = pc.list_value_length(batch.column(columns[0])).to_numpy(zero_copy_only=False)
    return [np.repeat(np.arange(batch.num_rows) + before, sizes), *(batch.column(c).flatten().to_numpy() for c in columns)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a document, which follow each other, to one; the last document waits for what the next rows have of it."""
    held = None
    for batch in batches:
        ends = np.cumsum(sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("codes", "p_codes")))
        low = 0
        while low < batch.num_rows:  # rows of PACK_ROWS hits at a time, one row at least
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PACK_ROWS, "right")))
            some = [b for b in (held, batch.slice(low, high - low)) if b is not None]
            docs = pa.concat_arrays([b.column("doc") for b in some]).dictionary_encode(null_encoding="encode")
            flat = [[np.concatenate(v) for v in zip(*(_flat(b, c, 0 if b is some[0] else some[0].num_rows) for b in some), strict=True)] for c in (_HITS, _PLACES)]
            of = docs.indices.to_numpy().astype(np.int64)
            whole = _packed(docs.dictionary, *((of[row], *values) for row, *values in flat))
            yield _finished(whole.slice(0, whole.num_rows - 1))
            held, low = whole.slice(whole.num_rows - 1), high
    if held is not None:
        yield _finished(held)


def _finished(batch: pa.RecordBatch) -> pa.RecordBatch:
    """`doc, codes, tfs, lengths` of documents whose places are all there; one without any hit goes."""
    doc, code, n, _, start, length = _flat(batch, _PLACES)
    heads = _runs(doc, code, start)
    heads = heads[np.diff(np.append(heads, len(doc))) == n[heads]]
    doc, code, length = doc[heads], code[heads], length[heads]
    heads = _runs(doc, code)
    phrases = doc[heads], code[heads], np.diff(np.append(heads, len(doc))), length[heads]
    hits = [np.concatenate(v) for v in zip(_flat(batch, _HITS), phrases, strict=True)]
    by = np.lexsort(hits[1::-1])
    owner, *values = (v[by] for v in hits)
    rows = pa.RecordBatch.from_arrays([batch.column("doc"), *_listed(batch.column("doc"), owner, *values)], ["doc", *_HITS])
    return rows.filter(pa.array(np.bincount(owner, minlength=batch.num_rows) > 0))


def _each(hits: DataFrame) -> DataFrame:
    """`doc, code, tf, length` of each hit."""
    one = hits.select("doc", F.explode(F.arrays_zip(*_HITS)).alias("hit"))
    return one.select("doc", F.col("hit.codes").alias("code"), F.col("hit.tfs").alias("tf"), F.col("hit.lengths").alias("length"))


def term_weights(hits: DataFrame, statistics: DataFrame) -> DataFrame:
    """`code, df, idf` of the terms that some document has; a query term counts as one phrase whatever words it matched."""
    frequency = hits.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    docs = statistics.select("docs").scalar()
    idf = F.ln((docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return cut_lineage(frequency.select("code", "df", F.when(idf > 0, idf).otherwise(MIN_IDF).alias("idf")))


def bm25(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    tf = tf.cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def _summed(hits: DataFrame, weighted: DataFrame, statistics: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """`query_id, doc, score, matched, terms`: documents with at least one term of the query, of those `within` (`doc`) if given.

    `weighted` has `query_id, code, idf, terms`. The hits of a document are in one task before the queries are joined: they are
    sent as one row, not as the many more rows of hits and queries.
    """
    least = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = hits.select(F.sum(F.size("codes"))).first()[0] or 0
    kept = hits.repartition(max(least, count // PART_HITS + 1), "doc")
    kept = kept if within is None else kept.join(within.select("doc"), "doc", "left_semi")
    met = _each(kept).join(broadcast_up_to(weighted, weighted.count()), "code")
    score = bm25(F.col("idf"), F.col("tf"), F.col("length"), statistics.select("mean_length").scalar())
    return met.groupBy("query_id", "doc").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("matched"), F.first("terms").alias("terms"))


def ranked_hits(queries: DataFrame, index: DataFrame, statistics: DataFrame, singular: bool = True, within: DataFrame | None = None) -> DataFrame:
    """`query_id, doc, score, matched, terms`: documents, of those `within` if given, with at least one term of the query.

    How rare a term is follows from all documents.
    """
    asked, q_terms = coded_terms(queries, singular)
    hits = term_hits(index, asked)
    counted = q_terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    weighted = q_terms.join(counted, "query_id").join(term_weights(hits, statistics).drop("df"), "code")
    return _summed(hits, cut_lineage(weighted), statistics, within)


def complete_hits(q_terms: DataFrame, hits: DataFrame, weights: DataFrame, statistics: DataFrame) -> DataFrame:
    """`query_id, doc, score`: documents with all terms of the query.

    A query begins with the documents of its rarest term, so no pair is made for a document that lacks it. As long as the
    queries can be sent to the tasks, all is decided in the row of the document.
    """
    term = F.struct("code", "idf")
    asked = cut_lineage(q_terms.where("query_id is not null").join(weights, "code", "left").groupBy("query_id").agg(
        F.min_by("code", F.struct(F.coalesce("df", F.lit(0)), "code")).alias("rarest"), F.collect_list(term).alias("terms"),
        F.min(F.coalesce("df", F.lit(0))).alias("least")).where("least > 0").drop("least"))
    mean_length = statistics.select("mean_length").scalar()
    if q_terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rarest = asked.select(F.collect_set("rarest")).scalar()
        first = hits.where("doc is not null").select("doc", *_HITS, mean_length.alias("mean"), F.explode(F.array_intersect("codes", rarest)).alias("rarest"))
        met = first.join(F.broadcast(asked), "rarest").where(F.size(F.array_except("terms.code", "codes")) == 0)

        def added(total: Column, t: Column) -> Column:
            at = F.array_position("codes", t["code"]).cast("int")
            return total + bm25(t["idf"], F.element_at("tfs", at), F.element_at("lengths", at), F.col("mean"))

        return met.select("query_id", "doc", F.aggregate("terms", F.lit(0.0), added).alias("score"))
    each = _each(hits)
    first = asked.join(each.select(F.col("code").alias("rarest"), "doc"), "rarest").select("query_id", "doc", F.size("terms").alias("n"), F.explode("terms").alias("t"))
    met = first.select("query_id", "doc", "n", "t.code", "t.idf").join(each, ["code", "doc"])
    score = F.sum(bm25(F.col("idf"), F.col("tf"), F.col("length"), mean_length)).alias("score")
    return met.groupBy("query_id", "doc", "n").agg(F.count(F.lit(1)).alias("matched"), score).where("matched = n").select("query_id", "doc", "score")


def top_hits(hits: DataFrame, limit: int) -> DataFrame:
    """The best `limit` documents per query; the rank filter is applied per task before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("doc"))
    return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)


def search_all_then_any(queries: DataFrame, index: DataFrame, statistics: DataFrame, limit: int = 10) -> DataFrame:
    """Documents with all terms; for a query that has none, with any term, marked `partial`.

    Documents with some term only are looked at for such queries alone.
    """
    asked, q_terms = coded_terms(queries)
    hits = term_hits(index, asked)
    weights = term_weights(hits, statistics)
    every = cut_lineage(complete_hits(q_terms, hits, weights, statistics))
    rest = q_terms.join(every.select("query_id").distinct(), "query_id", "left_anti").withColumn("terms", F.lit(None).cast("long"))
    some = _summed(hits, cut_lineage(rest.join(weights.drop("df"), "code")), statistics).select("query_id", "doc", "score")
    chosen = every.withColumn("partial", F.lit(False)).unionByName(some.withColumn("partial", F.lit(True)))
    return top_hits(chosen, limit).select("query_id", "place", "doc", "score", "partial")


def search_any(queries: DataFrame, index: DataFrame, statistics: DataFrame, docs: DataFrame,
               source: str = "", limit: int = 10) -> DataFrame:
    """Documents with any term, of one source if given; an empty query lists all by key."""
    docs = docs.where(F.col("source") == source) if source else docs
    hits = ranked_hits(queries, index, statistics, singular=False, within=docs if source else None)
    found = top_hits(hits, limit).select("query_id", "place", "doc", "score")
    blank = queries.where(F.trim("query") == "").select("query_id")
    first = docs.orderBy("doc").limit(limit).select(F.array_sort(F.collect_list("doc"))).scalar()
    everything = blank.select("query_id", F.posexplode(first).alias("at", "doc")).select(
        "query_id", (F.col("at") + 1).alias("place"), "doc", F.lit(0.0).alias("score"))
    return found.unionByName(everything)


def _dealt(texts: DataFrame) -> tuple[DataFrame, int]:
    """Texts, each with the `block` it goes to, and how many blocks there are: one has about BLOCK_TEXTS texts and BLOCK_CHARS characters."""
    texts = cut_lineage(texts.toDF("text").where("text is not null"))
    count, chars = texts.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(count // BLOCK_TEXTS, chars // BLOCK_CHARS) + 1
    return texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")), blocks


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted rows."""
    new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))[: len(keys[0])]
    return np.flatnonzero(new)


def _common_pairs(words: list[str], terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many pairs of neighbouring characters each word has in common with each term, and how many each text has.

    The ends of a text count as characters, and the k-th pair of a kind meets the k-th of its kind only.
    """
    texts = [*words, *terms]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    chars = np.frombuffer("".join(f"\x02{t}\x03" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.delete(np.arange(len(chars)), np.cumsum(sizes + 1) - 1)
    pair, owner = chars[begin] << 21 | chars[begin + 1], np.repeat(np.arange(len(texts)), sizes)
    by = np.lexsort((owner, pair))
    pair, owner = pair[by], owner[by]
    heads = _runs(pair, owner)
    k = np.arange(len(pair)) - np.repeat(heads, np.diff(np.append(heads, len(pair))))
    by = np.lexsort((owner, k, pair))
    pair, owner, k = pair[by], owner[by], k[by]
    heads = _runs(pair, k)
    common = np.zeros((len(words), len(terms)), np.int32)
    for low, high in zip(heads, np.append(heads[1:], len(pair)), strict=True):
        own = owner[low:high]  # words come before terms
        at = int(np.searchsorted(own, len(words)))
        if 0 < at < len(own):
            common[np.ix_(own[:at], own[at:] - len(words))] += 1
    return common, sizes


def similar_terms(words: DataFrame, vocabulary: DataFrame, cutoff: tuple[int, int] = (1, 2)) -> DataFrame:
    """`word, term, ratio` of upper-case words and terms whose ratio of common character pairs is at least `cutoff`.

    The ratio is 2 c / (a + b) for c common pairs out of a and b, ends of a text counting as characters. At a low cutoff
    most texts share some pair, so pairs of texts never become rows: blocks of words meet blocks of terms, a task counts
    the common pairs of two blocks in a table of their texts, and only what reaches the cutoff leaves it. Memory
    is that of two blocks; space is linear in the length of a text.
    """
    up, down = cutoff
    (left, rows), (right, columns) = _dealt(words), _dealt(vocabulary)

    def similar(met: pa.Table) -> pa.Table:
        own = met.column("asked").to_numpy()
        texts = met.column("text").combine_chunks()
        asked, known = texts.filter(pa.array(own)), texts.filter(pa.array(~own))
        word, term, ratio = [], [], []
        terms = known.to_pylist()
        step = max(1, BLOCK_TEXTS ** 2 // max(1, len(terms)))
        for low in range(0, len(asked) if terms else 0, step):
            some = asked.slice(low, step)
            common, sizes = _common_pairs(some.to_pylist(), terms)
            both = sizes[: len(some), None] + sizes[None, len(some):]
            at, to = np.nonzero((2 * down * common >= up * both) & (common > 0))
            word.append(at + low)
            term.append(to)
            ratio.append(2.0 * common[at, to] / both[at, to])
        none = np.zeros(0, np.int64)
        return pa.table({"word": asked.take(pa.array(np.concatenate([none, *word]))), "term": known.take(pa.array(np.concatenate([none, *term]))),
                         "ratio": pa.array(np.concatenate([none, *ratio]).astype(np.float64))})

    def sent(texts: DataFrame, own: str, other: str, others: int, asked: bool) -> DataFrame:
        return texts.select(F.col("block").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), F.lit(asked).alias("asked"), "text")

    met = sent(left, "row", "column", columns, True).unionByName(sent(right, "column", "row", rows, False))
    least = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, rows * columns // TASK_BLOCKS + 1)
    return met.repartition(tasks, "row", "column").groupBy("row", "column").applyInArrow(similar, "word string, term string, ratio double")


def closest_terms(words: DataFrame, vocabulary: DataFrame, k: int = 3, cutoff: tuple[int, int] = (1, 2)) -> DataFrame:
    """`word, place, term, ratio`: the `k` vocabulary terms most similar to each word, case aside; `word` in upper case.

    Of terms that differ in case only, the first is shown.
    """
    asked = words.select(F.upper("word").alias("word")).where("word <> ''").distinct()
    known = cut_lineage(vocabulary.groupBy(F.upper("term").alias("term")).agg(F.min("term").alias("shown")).where("term <> ''"))
    found = similar_terms(asked, known.select("term"), cutoff)
    best = Window.partitionBy("word").orderBy(F.col("ratio").desc(), "term")
    near = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return near.join(known, "term").select("word", "place", F.col("shown").alias("term"), "ratio")

"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text is measured in one pass. For every measure a sketch per language and source counts values in buckets whose
width follows the value (eight significant bits), so sketches merge by adding counts, are exact integers and the
same in every run. Limits come from the quartiles of a group's sketch; a group with few texts takes the merged sketch
of its language, and a small language that of all texts. Texts then meet the limits of their group in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from .tokens import BLANK, buffers, in_arrow, mixed, pieces, prefix_sums, row_sums, runs, span_codes

#: Words of a window that must not come twice.
WINDOW = 8
#: A text of fewer words fails, and one with a larger share (per cent) of words in repeated windows.
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Texts that a sketch needs to speak for its group.
LEAST_TEXTS = 200
#: Measures, per thousand words or lines: the least spread that counts as usual, and whether low values are odd too.
MEASURES = {"word_length": (500, True), "symbols": (20, False), "dup_lines": (100, False), "repeats": (50, False),
            "punctuation": (100, False), "capitals": (100, False)}
#: Limits lie so many spreads beyond the quartiles.
FENCE = 3
BITS = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_capitals"]


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a piece."""
    data, offsets = buffers(column)
    sums = prefix_sums(data)
    inside = ~BLANK[data]
    found = runs(data, offsets, inside, sums)
    n = len(column)
    out = {"n_words": np.diff(found.first), "word_chars": row_sums(inside & ((data & 0xC0) != 0x80), offsets),
           "n_symbols": row_sums(_SYMBOL[data], offsets), "n_punctuation": row_sums(_PUNCTUATION[data], offsets),
           "n_capitals": row_sums(_CAPITAL[data], offsets)}
    lines = runs(data, offsets, data != 10, sums)
    word_at = np.concatenate([[0], np.cumsum(inside)])
    full = word_at[lines.ends] > word_at[lines.starts]
    row = lines.row[full]
    out["n_lines"] = np.bincount(row, minlength=n)
    same = np.lexsort((lines.codes[full], row))
    out["n_dup_lines"] = np.bincount(row[same][1:][(np.diff(row[same]) == 0) & (lines.codes[full][same][1:] == lines.codes[full][same][:-1])], minlength=n)
    row, start = found.row, np.arange(max(0, len(found.codes) - WINDOW + 1))
    start = start[row[start] == row[start + WINDOW - 1]] if len(start) else start
    word_sums = prefix_sums(found.codes)
    window = mixed(span_codes(word_sums, start, start + WINDOW) + row[start].astype(np.uint64))  # equal in one text only
    order = np.argsort(window, kind="stable")
    twice = np.zeros(len(start), bool)
    equal = window[order][1:] == window[order][:-1]
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    steps = np.zeros(len(found.codes) + 1, np.int64)
    np.add.at(steps, start[twice], 1)
    np.add.at(steps, start[twice] + WINDOW, -1)
    out["n_repeat_words"] = row_sums(np.cumsum(steps)[:-1] > 0, found.first)
    return out


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of `docs` with the counts of each whole text."""
    docs = docs.select(*keep, F.col(f"`{text}`"))
    schema = T.StructType([*docs.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    place = len(keep)

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            parts = [counts(column.slice(low, high - low)) for low, high in pieces(column)]
            arrays = [pa.array(np.concatenate([p[c] for p in parts] or [np.zeros(0)]).astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], schema.names)

    return docs.transform(in_arrow, run, schema)


def measures() -> dict[str, Column]:
    """The measures as whole numbers, from the counts."""
    def per_thousand(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.expr(f"({part} * 1000) div {of}")).otherwise(0)

    return {"word_length": per_thousand("word_chars", "n_words"), "symbols": per_thousand("n_symbols", "n_words"),
            "dup_lines": per_thousand("n_dup_lines", "n_lines"), "repeats": per_thousand("n_repeat_words", "n_words"),
            "punctuation": per_thousand("n_punctuation", "n_words"), "capitals": per_thousand("n_capitals", "n_words")}


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: its eight highest bits, the others zero."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(values: DataFrame) -> DataFrame:
    """(lang, source, name, bucket, n) of the texts with their measures in columns."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return values.select("lang", "source", rows.alias("m")).groupBy("lang", "source", "m.name", "m.bucket").agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, texts, low, high) from the sketches merged over everything but `keys`."""
    merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "name")
    ranked = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("texts", F.sum("n").over(by))

    def quantile(percent: int) -> Column:  # the least bucket with at least that share of the texts up to it
        return F.min(F.when(F.col("upto") * 100 >= F.col("texts") * percent, F.col("bucket")))

    spread = F.greatest(F.col("q75") - F.col("q25"), F.element_at(F.create_map(*[F.lit(x) for m, (s, _) in MEASURES.items() for x in (m, s)]), F.col("name")))
    low_too = F.col("name").isin([m for m, (_, both) in MEASURES.items() if both])
    return ranked.groupBy(*keys, "name").agg(F.max("texts").alias("texts"), quantile(25).alias("q25"), quantile(75).alias("q75")).select(
        *keys, "name", "texts", F.when(low_too, F.col("q25") - FENCE * spread).otherwise(-1).alias("low"),
        (F.col("q75") + FENCE * spread).alias("high"))


def group_limits(sketch: DataFrame, least_texts: int) -> DataFrame:
    """(lang, source, limits): for each group the limits of the smallest sketch with enough texts around it."""
    own, lang, every = limits(sketch, ["lang", "source"]), limits(sketch, ["lang"]), limits(sketch, [])
    pair = lambda t, a, b: F.col(f"{t}.{a}").alias(b)
    joined = (own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.name") == F.col("l.name")))
              .join(F.broadcast(every).alias("e"), F.col("o.name") == F.col("e.name")))  # a row for each measure
    chosen = [F.when(F.col("o.texts") >= least_texts, F.col(f"o.{c}")).when(F.col("l.texts") >= least_texts, F.col(f"l.{c}"))
              .otherwise(F.col(f"e.{c}")).alias(c) for c in ("low", "high")]
    rows = joined.select(pair("o", "lang", "lang"), pair("o", "source", "source"), pair("o", "name", "name"), *chosen)
    return rows.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("low", "high")))).alias("limits"))


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
           least_texts: int = LEAST_TEXTS) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept for each row of `docs`.

    base_failed: fewer than 20 words, or over 30 % of the words in windows of eight words that the text holds twice.
    kept: not base_failed, and every measure within the limits of its language and source, which are learnt from the
    texts that pass the base rules. Null and empty texts have no words and fail. Null language or source is a group
    like any other. Repeated rows count each. Without texts that pass there are no limits and nothing is kept.
    """
    keep = [F.col(f"`{c}`").alias(a) for c, a in ((id_col, "doc_id"), (lang, "lang"), (source, "source"))]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = cut_lineage(counted(docs, keep, text).withColumn("base_failed", failed))
    values = rows.withColumns(measures())
    sketch = cut_lineage(sketches(values.filter("not base_failed")))
    found = cut_lineage(group_limits(sketch, least_texts)).withColumnRenamed("lang", "of_lang").withColumnRenamed("source", "of_source")
    joined = values.join(found, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    within = F.lit(True)
    for m in MEASURES:
        limit = F.col("limits")[m]
        within = within & bucket(F.col(m)).between(limit["low"], limit["high"])
    return joined.select("doc_id", "lang", "source", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def good(docs: DataFrame, **settings) -> DataFrame:
    """doc_id of the rows that are kept."""
    return judged(docs, **settings).filter("kept").select("doc_id")

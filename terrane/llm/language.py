"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all given texts per language and bucket: each task adds up its own counts and one
aggregation merges them. The matrix of log probabilities has a fixed number of buckets and one column per learned
language; it is sent to the tasks, which score texts in batches with numpy: each n-gram picks its row of the matrix,
and rows are summed per text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import buffers, in_arrow, mixed, pieces

#: Buckets of n-grams; orders of n-grams in characters; added count.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: The matrix holds at most so many languages (64 MB); more distinct labels are an error, not cut off.
MAX_LANGUAGES = 512
UNDETERMINED = "und"


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, and the offset of each text."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def grams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of every text; each order has buckets by its own hash."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    rows, out = [], []
    for n in ORDERS:
        count = max(0, len(points) - n + 1)
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[k : k + count]
        inside = row[:count] == row[n - 1 :]
        rows.append(row[:count][inside])
        out.append((mixed(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(rows), np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # (languages)
    matrix: np.ndarray  # (languages, buckets): log probabilities

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior probability."""
        names, scores = [], np.zeros(len(column))
        for low, high in pieces(column, 1 << 18):
            piece = column.slice(low, high - low)
            points, offsets = characters(piece)
            row, bucket = grams(points, offsets)
            total = np.empty((len(self.languages), high - low))
            for k in range(len(self.languages)):
                total[k] = np.bincount(row, self.matrix[k][bucket], high - low) + self.prior[k]
            letters = [any(map(str.isalpha, t or "")) for t in piece.to_pylist()]
            if len(self.languages):
                best = total.argmax(0)
                scores[low:high] = np.where(letters, 1 / np.exp(total - total.max(0)).sum(0), 0.0)
            names += [self.languages[best[k]] if letters[k] and self.languages else UNDETERMINED for k in range(high - low)]
        return names, scores


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the rows (text, lang); bucket -1 counts the texts."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for low, high in pieces(batch.column(0), 1 << 18):
                names = sorted(set(langs[low:high]))
                number = np.array([names.index(x) for x in langs[low:high]])
                row, bucket = grams(*characters(batch.column(0).slice(low, high - low)))
                table = np.bincount(number[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    counts[name] = counts.get(name, 0) + table[k]
                    texts[name] = texts.get(name, 0) + int((number == k).sum())
        for name, table in counts.items():
            used = np.flatnonzero(table)
            bucket, n = np.append(used, -1).astype(np.int32), np.append(table[used], texts[name]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bucket)), pa.array(bucket), pa.array(n)], ["lang", "bucket", "n"])

    return rows.select("text", "lang").transform(in_arrow, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", train: Column | None = None) -> Model:
    """Learn from the rows with a text and a language that satisfy `train`. Without any, the model knows no language."""
    rows = docs.filter(train) if train is not None else docs
    rows = rows.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    counts = gram_counts(rows).toPandas()
    table = np.zeros((len(names), BUCKETS))
    number = counts.lang.map({name: k for k, name in enumerate(names)}).to_numpy(int)
    gram = counts.bucket.to_numpy() >= 0
    table[number[gram], counts.bucket.to_numpy()[gram]] = counts.n.to_numpy()[gram]
    texts = np.zeros(len(names))
    texts[number[~gram]] = counts.n.to_numpy()[~gram]
    table += SMOOTHING
    return Model(names, np.log(texts / max(texts.sum(), 1)), np.log(table / table.sum(1, keepdims=True)))


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score.

    A text that is null or has no letter gets `und` and score 0, as does every text if no language was learned. Ties
    go to the language that comes first by code point. Other columns pass through; columns lang_pred and score of
    `docs` are replaced. Repeated rows get equal results; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return docs.transform(in_arrow, run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))

"""Toxicity by a counterfactual-regularised linear classifier.

A text is the set of its words, hashed. The words that tell the classes apart are chosen by statistics over all
labelled rows; a logistic model over them is fitted on a bounded sample. Besides the usual loss it is charged for
every change of score when an identity term of a sampled text is swapped for another of its kind, so the mention of
a group alone moves the score little. Scoring is one pass over the texts with the weights sent along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import buffers, in_arrow, pieces, words

#: Hash buckets of words, and how many of them the model may use at most.
BUCKETS = 1 << 18
FEATURES = 2048
#: Least chi-square (one degree of freedom) of a word that is used.
LEAST_CHI2 = 15.0
#: Labelled rows that the weights are fitted on at most, least hash first. The choice of words reads all labelled rows.
SAMPLE_ROWS = 20_000
#: A text is toxic from this score on.
THRESHOLD = 0.3
#: Labels are broadcast up to so many rows (16 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 2_000_000

# Terms for groups of people by kind, each in one form per language; swapped within a kind.
IDENTITY_TERMS = {
    "gender": "man woman men women male female boy girl boys girls transgender nonbinary mann frau männer frauen homme femme hommes femmes hombre mujer hombres mujeres",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer schwul lesbisch bisexuell lesbienne bisexuel lesbiana bisexuales",
    "religion": "christian muslim jewish hindu buddhist atheist catholic protestant sikh christen muslime juden chrétien musulman juif cristiano musulmán judío",
    "origin": "american european african asian mexican chinese indian arab turkish german french spanish polish russian deutsche türken français espagnol alemán francés",
    "skin": "black white brown schwarze weiße noir blanc negro blanco",
    "ability": "deaf blind disabled autistic gehörlos blinde behindert sourd aveugle handicapé sordo ciego discapacitado",
    "age": "young old elderly teenage alte junge jeune vieux joven viejo",
}


def word_bucket(word: str) -> int:
    """The bucket of one word, lower-cased in A-Z."""
    return int(words(*buffers(pa.array([word])), alnum=True).codes[0] % np.uint64(BUCKETS))


def row_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words of each text, without repeats, in order."""
    found = words(*buffers(column), alnum=True)
    both = np.unique(found.row * np.int64(BUCKETS) + (found.codes % np.uint64(BUCKETS)).astype(np.int64))
    return both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    """Feature number of each bucket (-1: none), weights and bias."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.bias)
        for low, high in pieces(column):
            row, bucket = row_buckets(column.slice(low, high - low))
            feature = self.place[bucket]
            used = feature >= 0
            total[low:high] += np.bincount(row[used], self.weights[feature[used]], high - low)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """(id, text, y) of the documents with a label; a document that is labelled both ways counts as 1."""
    marks = labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(
        F.col(f"`{id_col}`").alias("key")).agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("y"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.join(marks, F.col("id") == F.col("key")).select("id", "text", "y")


def word_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n1, n0): labelled texts of either class with a word in the bucket; bucket -1 counts the texts."""

    def run(batches):
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            counts = np.zeros((2, BUCKETS), np.int32)
            for low, high in pieces(batch.column(0)):
                row, bucket = row_buckets(batch.column(0).slice(low, high - low))
                for k in (0, 1):
                    counts[k] += np.bincount(bucket[y[low:high][row] == k], minlength=BUCKETS).astype(np.int32)
            used = np.flatnonzero(counts.any(0))
            bucket = np.append(used, -1).astype(np.int32)
            n1, n0 = (np.append(counts[k][used], (y == k).sum()).astype(np.int64) for k in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n1), pa.array(n0)], ["bucket", "n1", "n0"])

    return rows.select("text", "y").transform(in_arrow, run, "bucket int, n1 long, n0 long").groupBy("bucket").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _chi2(t1: int, t0: int) -> Column:
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    c, d = t1 - a, t0 - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below > 0, (t1 + t0) * (a * d - b * c) ** 2 / below).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        train: Column | None = None, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, pairing: float = 2.0,
        identity: dict[str, str] = IDENTITY_TERMS) -> Model:
    """The classifier for `label`, learnt from rows of `labels` with `train` (a condition on doc_id) only.

    Without labelled rows of both classes the model is a constant: the share of class 1, or 0 where there is none.
    """
    if train is not None:
        labels = labels.filter(train)
    rows = labelled(docs, labels, id_col, text, label)
    counts = word_counts(rows)
    total = counts.filter("bucket = -1").first()
    t1, t0 = (total.n1, total.n0) if total else (0, 0)
    place = np.full(BUCKETS, -1, np.int32)
    if not t1 or not t0:
        rate = t1 / (t1 + t0) if t1 + t0 else 0.0
        return Model(place, np.zeros(0), 500.0 if rate == 1 else -500.0)
    chosen = counts.filter("bucket >= 0").withColumn("chi2", _chi2(t1, t0)).filter(F.col("chi2") >= LEAST_CHI2).orderBy(
        F.desc("chi2"), "bucket").limit(features).select("bucket").toPandas().bucket.to_numpy()
    kinds = {kind: list(dict.fromkeys(word_bucket(w) for w in terms.split())) for kind, terms in identity.items()}
    chosen = np.unique(np.concatenate([chosen.astype(np.int64), *kinds.values()]).astype(np.int64))
    place[chosen] = np.arange(len(chosen))

    def run(batches):
        for batch in batches:
            sets = []
            for low, high in pieces(batch.column(1)):
                row, bucket = row_buckets(batch.column(1).slice(low, high - low))
                feature = place[bucket]
                row, feature = row[feature >= 0], feature[feature >= 0]
                sets += np.split(feature, np.searchsorted(row, np.arange(1, high - low)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.tolist() for s in sets], pa.list_(pa.int32()))], ["hash", "y", "features"])

    sample = rows.select(F.xxhash64(F.lit("fit"), "id").alias("hash"), "text", "y").transform(in_arrow, 
        run, "hash long, y int, features array<int>").orderBy("hash", "y", "features").limit(sample_rows).toPandas()
    sets = [np.array(s, np.int64) for s in sample.features]
    swaps = [(int(place[a]), int(place[b])) for s in sets for terms in kinds.values() if len(terms) > 1
             for k, a in enumerate(terms) if place[a] in s for b in (terms[(k + 1) % len(terms)], terms[k - 1])]
    weights, bias = descend(sets, sample.y.to_numpy().astype(float), len(chosen), np.array(swaps, np.int64).reshape(-1, 2), pairing)
    return Model(place, weights, bias)


def descend(sets: list[np.ndarray], y: np.ndarray, size: int, swaps: np.ndarray, pairing: float = 2.0, l2: float = 2e-4,
            steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias with the least mean of log loss, `l2` |w|^2 / 2 and `pairing` times the mean squared change
    of score over `swaps` (pairs of features that trade places); full-gradient Adam, the same result in every run."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)
    w = np.zeros(size + 1)
    rate_of_1 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(rate_of_1 / (1 - rate_of_1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(sets)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        grad = np.append(np.bincount(col, error[row], size) + l2 * w[:-1], error.sum())
        if len(swaps):
            change = 2 * pairing * (w[swaps[:, 0]] - w[swaps[:, 1]]) / len(swaps)
            grad[:-1] += np.bincount(swaps[:, 0], change, size) - np.bincount(swaps[:, 1], change, size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "_score") -> DataFrame:
    """`docs` with the score (0 to 1) of each whole text in `out`; null and empty texts get the score of no words.

    Other columns pass through; a column `out` of `docs` is replaced. Repeated rows and ties get equal scores.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(place)))], [*batch.schema.names, out])

    return docs.transform(in_arrow, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, train: Column | None = None, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The documents with a score below `threshold`, with the columns of `docs`."""
    model = fit(docs, labels, train=train, **settings)
    return scored(docs, model).filter(F.col("_score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])

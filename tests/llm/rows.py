"""Awkward documents for the tests: nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import random

from pyspark.sql import types as T

CLASHING = ["row", "id", "h", "size", "copies", "_fp", "key", "n", "pos", "found", "rate", "_found", "of_lang", "range", "place", "fid", "d", "least"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHING]])

WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gum", "hazel", "ivy", "juniper", "kapok", "larch", "maple", "nutmeg", "oak", "pine"]


def prose(seed: int, n: int) -> str:
    """n words without a regular pattern, a line end now and then."""
    rng = random.Random(seed)
    out = [f"{rng.choice(WORDS)}{rng.randrange(97)}" + ("." if k % 11 == 10 else "") for k in range(n)]
    return " ".join(out[: n // 2]) + "\n" + " ".join(out[n // 2 :]) if n > 1 else " ".join(out)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(CLASHING))


def awkward():
    twice = row(7, prose(7, 80))
    return [row(1, prose(1, 100)), row(2, None), row(3, ""), row(4, " \n\t "), row(5, prose(5, 60), None, None), row(None, prose(6, 60), "de", "b"),
            twice, twice, row(8, prose(1, 100), "fr", "c"), row(9, prose(9, 60_000), "en", None), row(None, None, None, None),
            row(10, "Ünïcödé ¡straße! 漢字 " * 10, "de", "b"), row(11, "the " * 300, "en", "a")]

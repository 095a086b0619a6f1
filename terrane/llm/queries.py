"""The registered queries of the subpackage: each operator over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogue, language, licenses, lines, mixing, ppm, quality, simhash, substring, toxicity, wrapper, zones

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo `parts`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


@register("op1_source_mix", sql=r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM d GROUP BY source
), w AS (
  SELECT source, s, CAST([5, 2, 1][(k - 1) % 3 + 1] AS HUGEINT) AS w, CAST(sum(s) OVER () AS HUGEINT) * 3 AS whole FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY CAST(s AS DOUBLE) / w, source IS NULL, source) AS place FROM w
), c AS (
  SELECT *, coalesce(sum(2 * s) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS used,
         sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o
), l AS (
  SELECT *, (whole - used) * w >= 2 * s * rest * 2 AS limited FROM c
), t AS (
  SELECT source, CAST(s AS BIGINT) AS source_size,
         CASE WHEN limited THEN CAST(2 * s AS DOUBLE)
              ELSE CAST(w * (whole - 2 * sum(CASE WHEN limited THEN 2 * s ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(2 * sum(CASE WHEN limited THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target,
         CAST(CAST('0x' || substr(md5('42:' || coalesce(source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM l
), r AS (
  SELECT doc_id, d.source, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT *, CAST(floor(rate * rank + u) - floor(rate * (rank - 1) + u) AS BIGINT) AS copies FROM r
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM n
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sources(read(spark, sf_dir, "documents"))


@register("op9_decontaminate", sql=r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS k FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM b WHERE len(w) > 0)
), n AS (SELECT DISTINCT n FROM i), t AS (
  SELECT k, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, n
), h AS (
  SELECT k, item_id, t.n, p FROM (SELECT k, n, p, array_to_string(w[p : p + n - 1], ' ') AS win FROM t) t JOIN i ON i.win = t.win AND i.n = t.n
), hit AS (
  SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM h) GROUP BY k
), it AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches_in_passes(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("_found"))
    return found.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_found.items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@register("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_words", "n_removed", "spans", "text")


@register("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), train=fold(F.col("doc_id"), 4) != 2)
    return toxicity.scored(docs, model, out="score").select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, train=fold(F.col("doc_id"), 4) != 2)
    return language.identified(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


_MEASURES_SQL = {
    "word_length": "word_chars * 1000 // n_words", "symbols": "n_symbols * 1000 // n_words", "dup_lines": "n_dup_lines * 1000 // n_lines",
    "repeats": "n_repeat_words * 1000 // n_words", "punctuation": "n_punctuation * 1000 // n_words", "capitals": "n_capitals * 1000 // n_words"}
_LIMITS_SQL = """
  SELECT {keys} name, max(texts) AS texts, min(bucket) FILTER (upto * 100 >= texts * 25) AS q25, min(bucket) FILTER (upto * 100 >= texts * 75) AS q75
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} name ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} name) AS texts
        FROM (SELECT {keys} name, bucket, count(*) AS n FROM m GROUP BY ALL)) GROUP BY ALL
"""
_QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), ln AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), wi AS (
  SELECT k, p, array_to_string(w[p : p + 7], ' ') AS win FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS p FROM d)
), rp AS (
  SELECT k, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT k, unnest(range(p, p + 8)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY k, win) AS c FROM wi) WHERE c > 1) GROUP BY k
), f AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) AS n_punctuation,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, k
  FROM d LEFT JOIN ln USING (k) LEFT JOIN rp USING (k)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
), v AS (
  SELECT k, lang, source, base_failed, s.name, s.v >> greatest(length(bin(s.v)) - 8, 0) << greatest(length(bin(s.v)) - 8, 0) AS bucket, s.spread, s.low_too
  FROM (SELECT k, lang, source, base_failed, unnest([VALUES]) AS s FROM b WHERE n_words > 0)
), m AS (SELECT * FROM v WHERE NOT base_failed),
o AS (OWN), l AS (LANG), e AS (EVERY), c AS (
  SELECT o.lang, o.source, o.name, CASE WHEN o.texts >= 200 THEN o.q25 WHEN l.texts >= 200 THEN l.q25 ELSE e.q25 END AS q25,
         CASE WHEN o.texts >= 200 THEN o.q75 WHEN l.texts >= 200 THEN l.q75 ELSE e.q75 END AS q75
  FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.name = l.name JOIN e ON o.name = e.name
), ok AS (
  SELECT k, bool_and((NOT low_too OR bucket >= q25 - 3 * greatest(q75 - q25, spread)) AND bucket <= q75 + 3 * greatest(q75 - q25, spread)) AS good
  FROM v JOIN c ON v.lang IS NOT DISTINCT FROM c.lang AND v.source IS NOT DISTINCT FROM c.source AND v.name = c.name GROUP BY k
)
SELECT doc_id, lang, source, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       CAST(n_punctuation AS BIGINT) AS n_punctuation, CAST(n_capitals AS BIGINT) AS n_capitals, base_failed,
       NOT base_failed AND coalesce(good, false) AS kept
FROM b LEFT JOIN ok USING (k)
""".replace("VALUES", ", ".join(f"{{'name': '{m}', 'v': CAST({_MEASURES_SQL[m]} AS BIGINT), 'spread': {s}, 'low_too': {str(t).lower()}}}" for m, (s, t) in quality.MEASURES.items())
            ).replace("OWN", _LIMITS_SQL.format(keys="lang, source,")).replace("LANG", _LIMITS_SQL.format(keys="lang,")).replace("EVERY", _LIMITS_SQL.format(keys=""))


@register("op6_quality", sql=_QUALITY_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"))


@register("op7_ppm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ppm.scored(docs, train=fold(F.col("doc_id"), 10) != 0).select(
        "doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op4_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extracted(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op3_license_scan", sql=licenses.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("_licences.sentences", ",").alias("sentences"), F.array_join("_licences.licences", ",").alias("licences"),
                        F.size("_licences.unmatched").cast("long").alias("n_unmatched"))


@register("op11_hard_negatives", sql=r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT * FROM (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
         other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
) WHERE rank <= 5
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return zones.hard_negatives(read(spark, sf_dir, "embeddings"), "vec_id", moved, "embedding", vec_id % 100 == 0)


@register("op12_line_dedup", sql=r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT k, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d
), y AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM y WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT k) >= 5
), j AS (
  SELECT k, y.doc_id, p, line, c.key IS NOT NULL AND y.doc_id IS DISTINCT FROM c.keeper AS gone FROM y LEFT JOIN c ON y.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY k
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WAY = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 'o': {0}.o || {3}}}"
_NONE = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}"


def _way(state: str, cost: object, letter: str, out: str = "''", only: str = "true") -> str:
    return f"CASE WHEN {only} THEN {_WAY.format(state, cost, letter, out)} ELSE {_NONE} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _said(role: str) -> str:
    return f"chr(10) || '{role}:' || text"


def _rerole(states: list[str], role: str) -> list[str]:
    return [_way(s, "1 + extra", "R", _said(role), "NOT bad") for s in states]


def _kept(states: list[str], initial: str) -> list[str]:
    return [_way(s, "extra", "K", "chr(10) || role || ':' || text", f"NOT bad AND initial = '{initial}'") for s in states]


_USER_SQL = _least("s2", *[_way(s, 5, "I", "chr(10) || 'user:'") for s in ("s0", "s1", "s3")])
_ASSISTANT_SQL = _least("s3", _way("s2", 5, "I", "chr(10) || 'assistant:'"))
_REPAIR_SQL = r"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations
), z AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(named, ''), lambda x: CAST(ascii(x) AS UBIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS UBIGINT[])),
                                         lambda v, n: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS UBIGINT)) ELSE v // 2 END)),
                CAST(4294967295 AS UBIGINT)) % 20 AS fault FROM h
), d AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE fault <> 0
), o AS (
  SELECT *, row_number() OVER w AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail,
         lag(left(role, 1)) OVER w || left(role, 1) AS pair
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))
), e AS (
  SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM o
), f AS (
  SELECT conv_id, turn, role, text, i, pair, blank, duplicate, blank OR duplicate AS bad, left(role, 1) AS initial,
         NOT blank AND NOT duplicate AND right(tail, 1) NOT IN ('.', '!', '?') AS truncated,
         CASE WHEN NOT blank AND NOT duplicate AND right(tail, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM e
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id
), r AS (
  SELECT conv_id, n, 0 AS done, {'c': CAST(0 AS BIGINT), 'a': '', 'o': ''} AS s0, NONE AS s1, NONE AS s2, NONE AS s3 FROM g
  UNION ALL
  SELECT q.conv_id, q.n, f.i, DELETE_0 AS s0, SYSTEM AS s1, USER AS s2, ASSISTANT AS s3 FROM (
    SELECT conv_id, n, done, s0, s1, s2, INSERT_A AS s3 FROM (SELECT conv_id, n, done, s0, s1, INSERT_U AS s2, s3 FROM r WHERE done < n)
  ) q JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.done + 1
), b AS (
  SELECT conv_id, list_min([s0, s3]) AS best FROM (
    SELECT conv_id, s0, INSERT_A AS s3 FROM (SELECT conv_id, s0, s1, INSERT_U AS s2, s3 FROM r WHERE done = n))
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
""".replace("NONE", _NONE).replace("DELETE_0", _way("s0", 2, "D")).replace(
    "SYSTEM", _least(_way("s1", 2, "D"), *_kept(["s0"], "s"))).replace(
    "USER", _least(_way("s2", 2, "D"), *_kept(["s0", "s1", "s3"], "u"), *_rerole(["s0", "s1", "s3"], "user"))).replace(
    "ASSISTANT", _least(_way("s3", 2, "D"), *_kept(["s2"], "a"), *_rerole(["s2"], "assistant"))).replace(
    "INSERT_U", _USER_SQL).replace("INSERT_A", _ASSISTANT_SQL)


@register("op13_dialogue_repair", sql=_REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    found = dialogue.reports(dialogue.damaged(conversations)).withColumnRenamed("conv_id", "_c")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

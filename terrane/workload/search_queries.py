"""Search over documents: index, ranking, fallback, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.search import build_index, closest_terms, corpus_statistics, ranked_hits, search_all_then_any, search_any
from ..session import cut_lineage, shared_dir, use_all_cores
from ..plans.lookup import search_datasets, search_indicators
from ..sources.files import catalogue_from_lines
from .base import query, similar_sql, table, view
from .cube_queries import toc_lines

_WORDS = "string_split_regex(replace(strip_accents(lower({c})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+')"
_STEM = "CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, -1) ELSE w END"
_FOLDED = "string_split_regex(replace(strip_accents(lower({c})), 'ß', 'ss'), '[\\s\\p{{Z}}]+')"
# a word of a query is its parts, joined by blanks
_PHRASE = "array_to_string(list_filter(string_split_regex({w}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ')"

view("tok", sql=f"SELECT doc, w FROM (SELECT doc_id AS doc, unnest({_WORDS.format(c='text')}) AS w FROM documents) WHERE w <> ''")
view("idx", "tok", sql="SELECT w AS term, doc, count(*) AS tf FROM tok GROUP BY ALL")
view("lens", "tok", sql="SELECT doc, count(*) AS length FROM tok GROUP BY doc")
view("btok", sql=f"SELECT item_id AS query_id, w FROM (SELECT item_id, unnest({_WORDS.format(c='text')}) AS w FROM benchmark) WHERE w <> ''")
# A query is a whole passage.
view("qwords", sql=f"SELECT DISTINCT query_id, w FROM (SELECT item_id AS query_id, unnest({_FOLDED.format(c='text')}) AS w FROM benchmark)")
view("qterms", "qwords", sql=f"SELECT DISTINCT query_id, {_PHRASE.format(w=_STEM)} AS q_term FROM qwords WHERE {_PHRASE.format(w=_STEM)} <> ''")


def _hits_views(prefix: str, terms: str, c: str = "", docs: str = "documents") -> None:
    """Hits and scores of `terms` on the corpus whose views start with `c`."""
    view(f"{prefix}hits", terms, f"{c}idx", sql=f"""
SELECT q_term, doc, sum(tf) AS tf FROM (SELECT DISTINCT q_term FROM {terms}) JOIN (SELECT DISTINCT term FROM {c}idx) v ON starts_with(v.term, q_term)
JOIN {c}idx USING (term) GROUP BY ALL
""")
    view(f"{prefix}score", f"{prefix}hits", f"{c}lens", terms, sql=f"""
SELECT query_id, doc, sum(s) AS score, count(*) AS matched FROM (
  SELECT q_term, doc, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6::DOUBLE END
         * tf * 2.2 / (tf + 1.2::DOUBLE * (0.25 + 0.75 * length / avg_length)) AS s
  FROM {prefix}hits JOIN (SELECT q_term, CAST(count(*) AS DOUBLE) AS df FROM {prefix}hits GROUP BY q_term) USING (q_term) JOIN {c}lens USING (doc),
       (SELECT CAST(count(*) AS DOUBLE) AS n FROM {docs}), (SELECT (SELECT count(*) FROM {c}tok)::DOUBLE / (SELECT count(*) FROM {docs}) AS avg_length))
JOIN {terms} USING (q_term) GROUP BY ALL
""")


_hits_views("q", "qterms")
view("rawterms", "qwords", sql=f"SELECT DISTINCT query_id, {_PHRASE.format(w='w')} AS q_term FROM qwords WHERE {_PHRASE.format(w='w')} <> ''")
_hits_views("r", "rawterms")


# Catalogue search: a query is a part name, a plural and a year.
view("cat", "toc", sql="""
SELECT code, title, data_start, data_end, last_update FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS rn FROM toc WHERE type IN ('dataset', 'table')) WHERE rn = 1
""")
view("ctok", "cat", sql=f"""
SELECT doc, w FROM (SELECT code AS doc, unnest({_WORDS.format(c="concat_ws(' ', code, title, data_start, data_end, last_update)")}) AS w FROM cat) WHERE w <> ''
""")
view("cidx", "ctok", sql="SELECT w AS term, doc, count(*) AS tf FROM ctok GROUP BY ALL")
view("clens", "ctok", sql="SELECT doc, count(*) AS length FROM ctok GROUP BY doc")
view("cterms", sql="""
SELECT DISTINCT query_id, CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, -1) ELSE w END AS q_term
FROM (SELECT p_name AS query_id, unnest(string_split(p_name || ' brands 19' || length(p_name) || '5', ' ')) AS w FROM part)
""")
_hits_views("c", "cterms", "c", "cat")


def documents(spark, sf):
    return use_all_cores(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text", "source"))


def indexed(spark, sf):
    """The documents and their index, the index written once as it would be at rest."""
    docs = documents(spark, sf)
    return docs, cut_lineage(build_index(docs, "text"))


def passages(spark, sf):
    """Each benchmark passage as a query text."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("term_statistics", "idx", sql="SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM idx GROUP BY term")
def term_statistics(spark, sf):
    return build_index(documents(spark, sf), "text").groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses"))


@query("corpus_statistics", "tok", sql="""
SELECT (SELECT count(*) FROM documents) AS docs, round((SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM documents), 6) AS mean_length""")
def corpus(spark, sf):
    docs = documents(spark, sf)
    return corpus_statistics(build_index(docs, "text"), docs).select("docs", F.round("mean_length", 6).alias("mean_length"))


@query("search_scores", "qscore", sql="SELECT query_id, doc, round(score, 6) AS score, matched FROM qscore")
def search_scores(spark, sf):
    docs, index = indexed(spark, sf)
    hits = ranked_hits(passages(spark, sf), index, corpus_statistics(index, docs))
    return hits.select("query_id", "doc", F.round("score", 6).alias("score"), "matched")


@query("search_all_then_any", "qscore", "qterms", sql="""
SELECT query_id, CAST(place AS INT) AS place, doc, round(score, 6) AS score, partial FROM (
  SELECT query_id, doc, score, NOT has_all AS partial, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS place
  FROM (SELECT *, max(matched) OVER (PARTITION BY query_id) = terms AS has_all
        FROM qscore JOIN (SELECT query_id, count(*) AS terms FROM qterms GROUP BY query_id) USING (query_id))
  WHERE NOT has_all OR matched = terms) WHERE place <= 10""")
def search_all(spark, sf):
    docs, index = indexed(spark, sf)
    return search_all_then_any(passages(spark, sf), index, corpus_statistics(index, docs)).withColumn(
        "score", F.round("score", 6))


@query("search_bm25_topk", "rscore", sql="""
SELECT query_id, CAST(place AS INT) AS place, doc, round(score, 6) AS score FROM (
  SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS place FROM rscore
  WHERE doc IN (SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents))) WHERE place <= 20
UNION ALL SELECT -1, CAST(row_number() OVER (ORDER BY doc_id) AS INT), doc_id, 0.0::DOUBLE FROM (
  SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY doc_id LIMIT 20)""")
def search_topk(spark, sf):
    docs, index = indexed(spark, sf)
    first = docs.agg(F.min("source")).first()[0]
    asked = passages(spark, sf).unionByName(spark.createDataFrame([(-1, " ")], "query_id bigint, query string"))
    return search_any(asked, index, corpus_statistics(index, docs), docs, first, 20).withColumn("score", F.round("score", 6))


@query("search_datasets", "cscore", "cterms", "cat", sql="""
SELECT query_id, CAST(place AS INT) AS place, code, title, data_start, data_end, round(score, 6) AS score, partial FROM (
  SELECT query_id, doc, score, NOT has_all AS partial, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS place
  FROM (SELECT *, max(matched) OVER (PARTITION BY query_id) = terms AS has_all
        FROM cscore JOIN (SELECT query_id, count(*) AS terms FROM cterms GROUP BY query_id) USING (query_id))
  WHERE NOT has_all OR matched = terms) JOIN cat ON code = doc WHERE place <= 10""")
def datasets(spark, sf):
    name = F.col("p_name")
    text = F.concat(name, F.lit(" Brands 19"), F.length(name), F.lit("5"))
    asked = table(spark, sf, "part").select(name.alias("query_id"), text.alias("query")).distinct()
    found = search_datasets(asked, catalogue_from_lines(toc_lines(spark, sf)))
    return found.withColumn("score", F.round("score", 6))


view("vocab", sql=f"SELECT DISTINCT upper(w) AS term FROM (SELECT unnest({_WORDS.format(c='text')}) AS w FROM conversations) WHERE w <> ''")


@query("closest_terms", "vocab", "btok", sql=f"""
SELECT word, CAST(place AS INT) AS place, lower(term) AS term, round(ratio, 9) AS ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY ratio DESC, term) AS place FROM (
    {similar_sql("SELECT w AS x FROM btok", "SELECT term AS x FROM vocab", (1, 2))})) WHERE place <= 3""")
def closest(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("word"))
    vocabulary = use_all_cores(table(spark, sf, "conversations")).select(F.explode(tokens(F.col("text"))).alias("term"))
    return closest_terms(words, vocabulary).withColumn("ratio", F.round("ratio", 9))


# --------------------------------------------------------------------- phrases

# The catalogue's words by place, with a gap between columns; a query is a code without its last letter.
view("cpos", "cat", sql=f"""
SELECT doc, flatten(list_transform(cols, lambda c: list_concat(list_filter(string_split_regex(replace(strip_accents(lower(c)), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ['']))) AS toks
FROM (SELECT code AS doc, [code, title, coalesce(data_start, ''), coalesce(data_end, ''), coalesce(last_update, '')] AS cols FROM cat)
""")
view("phrases", "toc", sql="""
SELECT code AS query_id, q_term, string_split(q_term, ' ') AS parts FROM (
  SELECT code, trim(replace(left(code, -1), '_', ' ')) AS q_term FROM (SELECT DISTINCT code FROM toc))
""")
view("phits", "cpos", "phrases", sql="""
SELECT q_term, doc, count(*) AS tf FROM (SELECT doc, toks, unnest(range(1, len(toks) + 1)) AS p FROM cpos) d
JOIN (SELECT DISTINCT q_term, parts FROM phrases) q ON d.toks[p] = q.parts[1] AND d.toks[p : p + len(parts) - 2] = q.parts[1 : len(parts) - 1]
  AND starts_with(coalesce(d.toks[p + len(parts) - 1], ''), q.parts[len(parts)]) GROUP BY ALL
""")


@query("search_phrase", "phits", "phrases", "clens", "cat", sql="""
SELECT query_id, CAST(place AS INT) AS place, code, title, data_start, data_end, round(score, 6) AS score, false AS partial FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS place FROM (
    SELECT query_id, doc, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6::DOUBLE END
           * tf * 2.2 / (tf + 1.2::DOUBLE * (0.25 + 0.75 * length / avg_length)) AS score
    FROM phits JOIN (SELECT q_term, CAST(count(*) AS DOUBLE) AS df FROM phits GROUP BY q_term) USING (q_term) JOIN clens USING (doc) JOIN phrases USING (q_term),
         (SELECT CAST(count(*) AS DOUBLE) AS n FROM cat), (SELECT (SELECT sum(length) FROM clens)::DOUBLE / (SELECT count(*) FROM cat) AS avg_length)))
JOIN cat ON code = doc WHERE place <= 10""")
def search_phrase(spark, sf):
    """Codes typed without their last letter: their parts must stand side by side, the last one may go on."""
    code = F.concat_ws("_", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), "p_size")
    asked = table(spark, sf, "part").select(code.alias("query_id"), F.expr("left(query_id, length(query_id) - 1)").alias("query")).distinct()
    found = search_datasets(asked, catalogue_from_lines(toc_lines(spark, sf)))
    return found.withColumn("score", F.round("score", 6))


@query("search_index_refresh", "cscore", "cterms", "cat", sql="""
SELECT query_id, CAST(place AS INT) AS place, code, title, data_start, data_end, round(score, 6) AS score, partial FROM (
  SELECT query_id, doc, score, NOT has_all AS partial, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS place
  FROM (SELECT *, max(matched) OVER (PARTITION BY query_id) = terms AS has_all
        FROM cscore JOIN (SELECT query_id, count(*) AS terms FROM cterms GROUP BY query_id) USING (query_id))
  WHERE NOT has_all OR matched = terms) JOIN cat ON code = doc WHERE place <= 10""")
def search_index_refresh(spark, sf):
    """An index at rest of an older catalogue, brought up to date by documents that are new, changed and gone, then searched."""
    catalogue = catalogue_from_lines(toc_lines(spark, sf))
    size = F.length("title") + F.length("code")
    older = catalogue.where(size % 7 != 0).withColumn("title", F.when(size % 5 == 0, F.concat(F.lit("before "), "title")).otherwise(F.col("title")))
    older = older.unionByName(catalogue.where(size % 3 == 0).withColumn("code", F.concat(F.lit("withdrawn_"), "code")))
    root = shared_dir(spark, "index")
    name = F.col("p_name")
    asked = table(spark, sf, "part").select(name.alias("query_id"), F.concat(name, F.lit(" Brands 19"), F.length(name), F.lit("5")).alias("query")).distinct()
    search_datasets(asked.limit(1), older, root=root)
    return search_datasets(asked, catalogue, root=root).withColumn("score", F.round("score", 6))


# ----------------------------------------------------------- specs, suggestions

view("kdocs", sql="""
SELECT 'spec_' || p_partkey AS doc, p_name AS label, p_type || ' of ' || p_brand AS description, CASE WHEN p_size % 3 = 0 THEN 'osm' ELSE 'eurostat' END AS source, p_size FROM part
""")
view("ktok", "kdocs", sql=f"SELECT doc, w FROM (SELECT doc, unnest({_WORDS.format(c="concat_ws(' ', doc, label, description)")}) AS w FROM kdocs) WHERE w <> ''")
view("kidx", "ktok", sql="SELECT w AS term, doc, count(*) AS tf FROM ktok GROUP BY ALL")
view("klens", "ktok", sql="SELECT doc, count(*) AS length FROM ktok GROUP BY doc")
view("kterms", sql="""
SELECT DISTINCT query_id, w AS q_term FROM (SELECT p_name AS query_id, unnest(string_split(lower(p_name || ' ' || left(p_type, 4)), ' ')) AS w FROM part) WHERE w <> ''
""")
_hits_views("k", "kterms", "k", "kdocs")


@query("search_indicators", "kscore", "kdocs", sql="""
SELECT query_id, CAST(place AS INT) AS place, doc AS id, label, source, p_size % 2 = 0 AS materialized, round(score, 6) AS score FROM (
  SELECT query_id, doc, score, label, source, p_size, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS place
  FROM kscore JOIN kdocs USING (doc) WHERE source = 'osm') WHERE place <= 10""")
def indicators(spark, sf):
    """Any term of a query in id, label or description of a spec table made from the parts; specs of one source."""
    size = F.col("p_size")
    parts = table(spark, sf, "part")
    ident = F.concat(F.lit("spec_"), "p_partkey")
    specs = parts.select(ident.alias("id"), F.col("p_name").alias("label"), F.lit("X").alias("unit"), F.when(size % 3 == 0, "osm").otherwise("eurostat").alias("source"),
                         F.lit("A").alias("frequency"), F.array(F.lit("NUTS1")).alias("geo_levels"), F.concat("p_type", F.lit(" of "), "p_brand").alias("description"))
    present = parts.where(size % 2 == 0).select(ident.alias("indicator"))
    asked = parts.select(F.col("p_name").alias("query_id"), F.concat("p_name", F.lit(" "), F.left("p_type", F.lit(4))).alias("query")).distinct()
    return search_indicators(asked, specs, present, "osm").select(
        "query_id", "place", "id", "label", "source", "materialized", F.round("score", 6).alias("score"))

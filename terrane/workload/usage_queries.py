"""Calls: who, how much, admitted or not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import call_status, client_label, fold, forwarded_address, shorten
from ..operators.usage import admit, attribute_clients, daily_usage, trailing_load
from .base import query, table
from .shapes import calls

DAY = 86_400
_STATUS = ("CASE WHEN conv_id % 6 = 5 THEN 'error:KeyError' WHEN conv_id % 6 = 0 THEN 'quota' WHEN conv_id % 6 = 1 THEN 'burst' "
           "WHEN conv_id % 6 IN (2, 3) THEN 'empty' WHEN starts_with(text, 'Aucun') OR starts_with(text, 'Erreur') THEN 'empty' ELSE 'ok' END")


@query("client_label", sql="SELECT event_id, event_type || ':' || left(sha256('u' || user_id), 10) AS label FROM events")
def labels(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", client_label(F.col("event_type"), F.concat(F.lit("u"), "user_id")).alias("label"))


@query("call_status", sql=f"SELECT conv_id, turn, {_STATUS} AS status FROM conversations")
def statuses(spark, sf):
    group, text = F.col("conv_id") % 6, F.col("text")
    reply = (F.when(group == 0, F.concat(F.lit("Erreur : quota "), text)).when(group == 1, F.concat(F.lit("Erreur : trop d'appels "), text))
             .when(group == 2, F.concat(F.lit("Erreur "), text)).when(group == 3, F.concat(F.lit("Aucune "), text)).otherwise(text))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", call_status(reply, F.when(group == 5, "KeyError")).alias("status"))


@query("long_values", sql="SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS shown FROM documents")
def long_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", shorten(F.col("text")).alias("shown"))


@query("folded_text", sql="SELECT doc_id, md5(replace(strip_accents(lower(text)), 'ß', 'ss')) AS digest FROM documents")
def folded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("digest"))


@query("forwarded_addresses", sql="""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '198.51.100.' || (user_id % 250) WHEN 1 THEN '1.1.1.' || (user_id % 250) ELSE '10.0.0.1' END AS address FROM events""")
def forwarded(spark, sf):
    u = F.col("user_id") % 250
    chain = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("1.1.1.1, 198.51.100."), u)).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit(" 1.1.1."), u)).otherwise(" , ")
    return table(spark, sf, "events").select("event_id", forwarded_address(F.lit("10.0.0.1"), chain, 1).alias("address"))


@query("client_attribution", sql="""
WITH keys AS (SELECT 'k' || c_custkey AS key, max(CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' ELSE 'free' END) AS tier FROM customer GROUP BY c_custkey),
r AS (SELECT event_id, user_id, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.7' AS ip,
  CASE event_type WHEN 'purchase' THEN 'k' || user_id WHEN 'signup' THEN 'k' || user_id WHEN 'error' THEN 'zz ' || user_id END AS key FROM events),
s AS (SELECT *, EXISTS (SELECT 1 FROM nation WHERE user_id % 256 BETWEEN n_nationkey * 8 AND n_nationkey * 8 + 1) AS shared FROM r)
SELECT CAST(event_id AS BIGINT) AS request_id, CASE WHEN tier IS NOT NULL THEN 'key' WHEN shared THEN 'shared' ELSE 'ip' END AS kind,
       CASE WHEN tier IS NOT NULL THEN s.key WHEN shared THEN 'shared' ELSE ip END AS ident,
       CASE WHEN tier IS NOT NULL THEN tier WHEN shared THEN 'shared' WHEN s.key IS NOT NULL THEN 'badkey' ELSE 'anon' END AS tier
FROM s LEFT JOIN keys ON keys.key = s.key""")
def attribution(spark, sf):
    user, kind = F.col("user_id"), F.col("event_type")
    key = F.concat(F.lit("k"), user)
    requests = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.lit("192.0.2.1").alias("ip"),
        F.concat(F.lit("1.1.1.1, 10."), user % 256, F.lit("."), F.col("event_id") % 256, F.lit(".7")).alias("forwarded"),
        F.when(kind == "purchase", F.create_map(F.lit("x-api-key"), key)).when(
            kind == "signup", F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer "), key))).otherwise(
            F.create_map(F.lit("accept"), F.lit("*"))).alias("headers"),
        F.when(kind == "error", F.concat(F.lit("a=1&key=zz%20"), user)).alias("query"))
    keys = table(spark, sf, "customer").select(
        F.concat(F.lit("k"), "c_custkey").alias("key"),
        F.when(F.col("c_mktsegment") == "BUILDING", "pro").when(F.col("c_mktsegment") == "MACHINERY", "gold").otherwise("free").alias("tier"))
    networks = table(spark, sf, "nation").select(F.concat(F.lit("10."), F.col("n_nationkey") * 8, F.lit(".3.4/15")).alias("cidr"))
    return attribute_clients(requests, keys, networks, hops=1)


@query("daily_usage", "calls", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS day, client, any_value(tier) AS tier, CAST(sum(weight) AS BIGINT) AS used,
       CAST(CASE any_value(tier) WHEN 'pro' THEN -1 WHEN 'free' THEN 6 WHEN 'shared' THEN 8 ELSE 4 END AS INT) AS "limit",
       coalesce(sum(weight) > CASE any_value(tier) WHEN 'pro' THEN NULL WHEN 'free' THEN 6 WHEN 'shared' THEN 8 ELSE 4 END, false) AS over
FROM calls GROUP BY ALL""")
def usage(spark, sf):
    return daily_usage(calls(spark, sf), {"free": 6, "shared": 8, "anon": 4}).withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn(
        "limit", F.coalesce("limit", F.lit(-1)))


@query("trailing_usage", "calls", sql=f"""
SELECT call_id, client, CAST(sum(weight) OVER (PARTITION BY client ORDER BY epoch_us(ts) RANGE BETWEEN {DAY * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS load FROM calls""")
def trailing(spark, sf):
    return trailing_load(calls(spark, sf), DAY).select("call_id", "client", "load")


def admission_calls(spark, sf, events=None):
    """Calls with their client kind; shared clients have sessions."""
    rows = calls(spark, sf, events)
    shared = F.col("tier") == "shared"
    return rows.select(
        "call_id", "ts", F.when(shared, "shared").when(F.col("tier").isin("pro", "free"), "key").otherwise("ip").alias("kind"),
        F.when(shared, "shared").otherwise(F.col("client")).alias("ident"), "tier",
        F.when(shared & (F.col("user_id") % 10 == 4), F.col("client")).otherwise("").alias("session"), "weight")


ADMISSION = dict(limits={"free": 5, "shared": 60, "anon": 4}, burst=3, seconds=6 * 3600)


# One step per call and client: what was admitted in the last window, and the weight of the day.
ADMISSION_SQL = f"""
SELECT call_id, client, verdict FROM (WITH RECURSIVE n AS (
  SELECT call_id, label AS client, CAST(ts AS DATE) AS day, epoch_us(ts) AS us, weight, tier, lim,
         CASE WHEN tier = 'pro' THEN NULL WHEN kind = 'shared' THEN CASE WHEN user_id % 10 = 4 THEN 'shared:u' || user_id END ELSE label END AS bucket,
         row_number() OVER (PARTITION BY label ORDER BY ts, call_id) AS k
  FROM (SELECT *, kind || ':' || left(sha256(CASE WHEN kind = 'shared' THEN 'shared' ELSE client END), 10) AS label FROM (
    SELECT *, CASE WHEN tier = 'shared' THEN 'shared' WHEN tier IN ('pro', 'free') THEN 'key' ELSE 'ip' END AS kind,
           CASE tier WHEN 'free' THEN 5 WHEN 'shared' THEN 60 WHEN 'anon' THEN 4 END AS lim FROM calls))),
run AS (
  SELECT client, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS used,
         CAST([] AS STRUCT(us BIGINT, b VARCHAR, w BIGINT)[]) AS recent FROM (SELECT DISTINCT client FROM n)
  UNION ALL
  SELECT client, k, call_id, verdict, day, CASE WHEN verdict = 'admitted' THEN used + weight ELSE used END,
         CASE WHEN verdict = 'admitted' AND bucket IS NOT NULL THEN list_append(live, {{'us': us, 'b': bucket, 'w': CAST(weight AS BIGINT)}}) ELSE live END
  FROM (SELECT *, CASE WHEN tier = 'pro' THEN 'admitted'
                WHEN bucket IS NOT NULL AND coalesce(list_sum(list_transform(list_filter(live, lambda x: x.b = bucket), lambda x: x.w)), 0) + weight > {ADMISSION["burst"]} THEN 'burst'
                WHEN used + weight > lim THEN 'daily' ELSE 'admitted' END AS verdict
        FROM (SELECT n.client, n.k, n.call_id, n.day, n.us, n.weight, n.tier, n.lim, n.bucket, CASE WHEN run.day = n.day THEN run.used ELSE 0 END AS used,
                     list_filter(run.recent, lambda x: x.us > n.us - {ADMISSION["seconds"] * 1_000_000}) AS live
              FROM run JOIN n ON n.client = run.client AND n.k = run.k + 1)))
SELECT * FROM run WHERE k > 0)"""


@query("admission_control", "calls", sql=ADMISSION_SQL)
def admission(spark, sf):
    return admit(admission_calls(spark, sf), **ADMISSION)

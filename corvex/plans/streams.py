"""State and metric queries over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvex.operators.chunking import ordered_text
from corvex.plans.base import LINES_SQL, lines, query, table, written
from corvex.shared import shared_dir
from corvex.streaming import limits, metrics
from corvex.streaming.ingestion import Ingestion


def requests(spark, sf):
    e = table(spark, sf, "events")
    profile = F.when(F.col("event_type") == "error", "reasoning").when(F.col("event_type") == "view", "fast").otherwise("default")
    return e.select(F.col("event_id").alias("request_id"), F.concat_ws(":", F.lit("w"), F.col("user_id") % 5, profile).alias("key"), profile.alias("profile"), F.date_trunc("second", F.timestamp_seconds(F.unix_timestamp("ts") / 60)).alias("ts"))


# Request by request of every key, the allowed ones of the last minute carried along.
_LIMIT_SQL = """WITH RECURSIVE q AS (SELECT event_id AS request_id, 'w:' || (user_id % 5) || ':' || p AS key, CASE p WHEN 'reasoning' THEN 10 WHEN 'fast' THEN 30 ELSE 120 END AS lim, floor(epoch(ts) / 60) AS t
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'reasoning' WHEN 'view' THEN 'fast' ELSE 'default' END AS p FROM events)),
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, request_id) AS n FROM q),
  walk AS (SELECT key, n, request_id, [t] AS log, true AS allowed, lim - 1 AS remaining, 0 AS retry_after FROM r WHERE n = 1
    UNION ALL SELECT key, n, request_id, CASE WHEN len(live) < lim THEN list_append(live, t) ELSE live END, len(live) < lim, CASE WHEN len(live) < lim THEN lim - len(live) - 1 ELSE 0 END, CASE WHEN len(live) < lim THEN 0 ELSE greatest(floor(60 - (t - live[1]))::INT, 1) END
    FROM (SELECT r.*, list_filter(w.log, lambda x: x > r.t - 60) AS live FROM walk w JOIN r ON r.key = w.key AND r.n = w.n + 1))
  SELECT request_id, key, allowed, remaining::INT AS remaining, retry_after::INT AS retry_after FROM walk"""
_CLAIM_SQL = """WITH RECURSIVE q AS (SELECT event_id AS request_id, user_id AS key, sha256((trunc(value)::INT % 2)::VARCHAR) AS h, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'in_progress' ELSE 'completed' END AS outcome, epoch(ts)::DOUBLE AS t FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, request_id) AS n FROM q),
  walk AS (SELECT key, n, request_id, h AS hash, outcome AS status, t AS locked, 'new' AS result FROM r WHERE n = 1
    UNION ALL SELECT key, n, request_id, CASE WHEN taken THEN h ELSE hash END, CASE WHEN taken THEN outcome ELSE status END, CASE WHEN taken THEN t ELSE locked END, CASE WHEN taken THEN 'reclaimed' WHEN hash = h AND status = 'completed' THEN 'replay' ELSE 'conflict' END
    FROM (SELECT r.*, w.hash, w.status, w.locked, w.locked + 86400 <= r.t OR (w.hash = r.h AND (w.status = 'failed' OR (w.status = 'in_progress' AND r.t - w.locked >= 900))) AS taken FROM walk w JOIN r ON r.key = w.key AND r.n = w.n + 1))
  SELECT request_id, result FROM walk"""


@query("m01_rate_limit", _LIMIT_SQL)
def rate_limit(spark, sf):
    """Event times run sixty times as fast, so that limits are met."""
    return limits.rate_limit(requests(spark, sf))


def claims(spark, sf):
    e = table(spark, sf, "events")
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "in_progress").otherwise("completed")
    return e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("k"), "user_id").alias("key"), F.sha2((F.col("value").cast("int") % 2).cast("string"), 256).alias("request_hash"), outcome.alias("outcome"), "ts", "event_type")


@query("l04_idempotency_claims", _CLAIM_SQL)
def idempotency_claims(spark, sf):
    return limits.idempotency(claims(spark, sf))


@query("n06_replayed_responses", _CLAIM_SQL.replace("SELECT request_id, result FROM walk", """, a AS (SELECT w.request_id, w.key, w.n, result, CASE WHEN result IN ('new', 'reclaimed') AND outcome = 'completed' THEN 'done:' || event_type || ':' || w.request_id END AS own FROM walk w JOIN r USING (request_id) JOIN events ON event_id = w.request_id),
  h AS (SELECT *, max(CASE WHEN result IN ('new', 'reclaimed') THEN n END) OVER (PARTITION BY key ORDER BY n) AS holder FROM a)
  SELECT h.request_id, h.result, CASE WHEN h.result IN ('new', 'reclaimed') THEN h.own WHEN h.result = 'replay' THEN o.own || ' again for ' || h.request_id END AS response,
    string_split(CASE WHEN h.result IN ('new', 'reclaimed') THEN h.own WHEN h.result = 'replay' THEN o.own || ' again for ' || h.request_id END, ':')[2] AS resource_id FROM h LEFT JOIN a o ON o.key = h.key AND o.n = h.holder"""))
def replayed_responses(spark, sf):
    """Responses made, transformed on replay, and read for their resource by callbacks."""
    return limits.respond(
        claims(spark, sf), lambda r: F.concat_ws(":", F.lit("done"), r["event_type"], r["request_id"]), lambda response, r: F.concat(response, F.lit(" again for "), r["request_id"]),
        lambda response: F.split(response, ":")[1])


@query("l04_first_claims", "SELECT user_id, min(event_id) AS event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 GROUP BY user_id")
def first_claims(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("m02_rate", "SELECT start, event_type, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM (SELECT event_type, unnest(generate_series(0, 19)) AS i, time_bucket(INTERVAL 15 SECOND, ts) - INTERVAL 15 SECOND * i AS start FROM events) GROUP BY start, event_type")
def rate(spark, sf):
    return metrics.rate(table(spark, sf, "events"), ["event_type"])


@query("m03_increase", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def increase(spark, sf):
    return metrics.increase(table(spark, sf, "events"), ["event_type"])


@query("m04_histogram_p95", """WITH b AS (SELECT event_type, (value > 1.0)::INT + (value > 2.5)::INT + (value > 5.0)::INT + (value > 10.0)::INT + (value > 25.0)::INT + (value > 50.0)::INT AS b, count(*) AS n FROM events GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS cum, sum(n) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS target FROM b), h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY b) AS k FROM c WHERE cum >= target)
  SELECT event_type, round(CASE WHEN b >= 6 THEN 50.0 ELSE e[b + 1] + (e[b + 2] - e[b + 1]) * (target - (cum - n)) / n END, 6) AS q FROM (SELECT *, [0.0, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0]::DOUBLE[] AS e FROM h WHERE k = 1)""")
def histogram_p95(spark, sf):
    return metrics.histogram_quantile(table(spark, sf, "events"), "event_type")


@query("m05_counters", "SELECT event_type, user_id % 4 AS shard, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def counters(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 4).alias("shard")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("m02_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf):
    return metrics.sessions(table(spark, sf, "events"), "user_id")


@query("m09_connector_cursor", "SELECT user_id % 7 AS connector, max(event_id) AS cursor, count(*) AS changes FROM events GROUP BY ALL")
def connector_cursor(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("connector")).agg(F.max("event_id").alias("cursor"), F.count("*").alias("changes"))


@query("m07_provider_fallback", "SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS served_by, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def provider_fallback(spark, sf):
    good = F.when(F.col("event_type") != "error", F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", good).alias("served_by"), F.count_if(F.col("event_type") == "error").alias("failures"))


@query("m08_expired_claims", "SELECT user_id, count(*) FILTER (gap > 86400) AS expired, count(*) FILTER (gap BETWEEN 900 AND 86400) AS stale FROM (SELECT user_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events)) GROUP BY user_id")
def expired_claims(spark, sf):
    from pyspark.sql.window import Window

    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return e.withColumn("gap", gap).groupBy("user_id").agg(F.count_if(F.col("gap") > 86400).alias("expired"), F.count_if(F.col("gap").between(900, 86400)).alias("stale"))


@query("m10_ingestion", f"""WITH {LINES_SQL}, n AS (SELECT document_id, count(*) FILTER (order_index % 20 <> 0) AS n FROM lines GROUP BY document_id)
  SELECT document_id::VARCHAR AS document_id, CASE WHEN document_id % 11 = 0 THEN 'dead' ELSE 'ready' END AS status, CASE WHEN document_id % 11 = 0 THEN 3 ELSE 1 END AS attempt,
    CASE WHEN document_id % 11 = 0 THEN 0 WHEN document_id % 5 = 0 AND document_id % 3 < 2 THEN 1 ELSE n END AS n_chunks FROM n""")
def ingestion(spark, sf):
    """Every document through the stages in three batches; every fifth comes again, shorter, in the last; every eleventh is of a type without a parser, and given up."""
    own = lines(spark, sf)
    i = F.col("document_id")
    text = ordered_text("order_index", F.concat(F.when(F.col("order_index") % 20 == 0, "# ").otherwise(""), "content"), "\n\n")
    kind = F.when(i % 11 == 0, "pdf").otherwise("markdown")
    first = own.groupBy("document_id").agg(text.cast("binary").alias("content")).select(i.cast("string").alias("document_id"), kind.alias("source_type"), "content", F.lit(1).alias("version"), (i % 3).alias("batch"))
    again = own.where("document_id % 5 = 0 AND document_id % 3 < 2").select("document_id").distinct().select(i.cast("string").alias("document_id"), kind.alias("source_type"), F.lit("again").cast("binary").alias("content"), F.lit(2).alias("version"), F.lit(2).cast("long").alias("batch"))
    files = written(first.unionByName(again), "files")
    run = Ingestion(spark, f"{shared_dir(spark)}/corvex-ingestion-{uuid.uuid4().hex}")
    for batch in range(6):  # the last three only retry
        run.run_batch(files.where(F.col("batch") == batch).drop("batch"), batch)
    return run.statuses().select("document_id", "status", "attempt", "n_chunks")

"""Queries of ordered passes: table groups, equation fragments, provider fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvex.operators import fallback as B
from corvex.operators import item_folds as I
from corvex.operators import pdf_items as P
from corvex.plans.base import LINES_SQL, lines, query, table
from corvex.plans.evaluation import items

_TABLE_ITEMS = """items AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN order_index END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY order_index ROWS UNBOUNDED PRECEDING) AS context FROM (
  SELECT document_id, order_index, (order_index // 6 + 1)::INT AS page_no, CASE WHEN order_index % 11 = 0 THEN 'heading' WHEN order_index % 7 = 3 THEN 'table_caption' WHEN order_index % 3 = 1 THEN 'table_row' ELSE 'paragraph' END AS kind,
    CASE WHEN order_index % 4 <> 0 THEN 'Table ' || order_index // 9 WHEN order_index % 8 = 0 THEN 'table' END AS label,
    CASE WHEN order_index % 7 = 3 THEN 't' || order_index WHEN order_index % 13 = 4 THEN 't' || (order_index - 1) END AS table_id FROM lines))"""


def table_items(spark, sf):
    """Lines as headings, captions, table rows (some name their table, some a label) and paragraphs, by position."""
    n = F.col("order_index")
    kind = F.when(n % 11 == 0, "heading").when(n % 7 == 3, "table_caption").when(n % 3 == 1, "table_row").otherwise("paragraph")
    label = F.when(n % 4 != 0, F.concat(F.lit("Table "), F.floor(n / 9))).when(n % 8 == 0, "table")
    own = F.when(n % 7 == 3, F.concat(F.lit("t"), n)).when(n % 13 == 4, F.concat(F.lit("t"), n - 1))
    text = F.when(kind == "heading", n.cast("string")).otherwise("")  # the fold reads headings' texts alone: here their place, which tells them apart
    return lines(spark, sf).select(F.col("document_id").alias("doc_id"), n.alias("item_index"), kind.alias("kind"), text.alias("text"), (F.floor(n / 6) + 1).cast("int").alias("page_no"), F.lit(1).alias("level"), own.alias("table_id"), label.alias("caption_label"))


_GROUPED = _TABLE_ITEMS + """, caps AS (SELECT document_id, order_index AS at_, page_no, context, lower(label) AS label, table_id FROM items WHERE kind = 'table_caption'),
  pairs AS (SELECT r.document_id, r.order_index, r.page_no, r.label AS own, c.table_id AS chosen, c.label AS chosen_label, row_number() OVER (PARTITION BY r.document_id, r.order_index ORDER BY coalesce((r.table_id = c.table_id)::INT, 0) DESC,
      CASE WHEN lower(r.label) <> 'table' AND lower(r.label) = c.label THEN 0 WHEN r.page_no = c.page_no THEN 1 ELSE 2 END, (c.at_ > r.order_index)::INT, (r.context IS DISTINCT FROM c.context)::INT, abs(c.at_ - r.order_index)) AS best
    FROM items r LEFT JOIN caps c USING (document_id) WHERE r.kind = 'table_row'),
  rowed AS (SELECT document_id, order_index, page_no, own, chosen, chosen_label FROM pairs WHERE best = 1),
  grouped AS (SELECT document_id AS doc_id, order_index AS item_index, 'table_row' AS kind, chosen AS table_id, coalesce(chosen_label, own) AS caption_label, CASE WHEN chosen IS NULL THEN 'unassigned_row' ELSE 'row_backed' END AS status,
      CASE WHEN chosen IS NULL THEN 'Unassigned table row on page ' || page_no || ' could not be matched to a caption.' END AS warning FROM rowed
    UNION ALL SELECT c.document_id, c.at_, 'table_caption', c.table_id, c.label, CASE WHEN n > 0 THEN 'row_backed' ELSE 'caption_only' END, CASE WHEN coalesce(n, 0) = 0 THEN 'Table caption ''' || coalesce(c.label, 'Table') || ''' had no recoverable table rows.' END
      FROM caps c LEFT JOIN (SELECT document_id, chosen AS table_id, count(*) AS n FROM rowed GROUP BY ALL) USING (document_id, table_id))"""


@query("k07_table_groups", f"WITH {LINES_SQL}, {_GROUPED} SELECT doc_id, item_index, kind, table_id, caption_label, status, warning FROM grouped")
def table_groups(spark, sf):
    grouped = I.group_tables(table_items(spark, sf)).where("kind IN ('table_caption', 'table_row')")
    return grouped.select("doc_id", "item_index", "kind", F.when(F.col("status") != I.UNASSIGNED, F.col("table_id")).alias("table_id"), "caption_label", "status", "warning")


@query("k07_table_warnings", f"WITH {LINES_SQL}, {_GROUPED}, first AS (SELECT doc_id, warning, min((kind = 'table_caption')::INT * 1000000 + item_index) AS pos FROM grouped WHERE warning IS NOT NULL GROUP BY ALL) SELECT doc_id, list_aggregate(list(warning ORDER BY pos), 'string_agg', ' ') AS warnings FROM first GROUP BY doc_id")
def table_warnings(spark, sf):
    return I.table_warnings(I.group_tables(table_items(spark, sf))).select("doc_id", F.array_join("warnings", " ").alias("warnings"))


def classified_equations(spark, sf):
    """The equations of all documents, with their fragments. Only what the fold reads goes through it."""
    return I.merge_equations(P.classify_items(items(spark, sf)).select("doc_id", "item_index", "kind", "text", "page_no"), ("equation",))


@query("k09_equation_groups")
def equation_groups(spark, sf):
    return classified_equations(spark, sf).select("doc_id", "item_index", "text", "merged", "orphan")


# Profiles by order priority, with up to three targets of up to three attempts; every line of an order tells what one attempt came to.
_CHAINS = [("1-URGENT", 0, "alpha", True, 2), ("1-URGENT", 1, "beta", True, 1), ("1-URGENT", 2, "gamma", True, 0), ("2-HIGH", 0, "beta", True, 0), ("2-HIGH", 1, "alpha", True, 2),
           ("3-MEDIUM", 0, "delta", False, 2), ("3-MEDIUM", 1, "gamma", True, 1), ("4-NOT SPECIFIED", 0, "gamma", True, 0), ("4-NOT SPECIFIED", 1, "delta", False, 1)]
_CHAINS_SQL = "chains AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}, '{v}', {str(r).lower()}, {m})" for p, n, v, r, m in _CHAINS) + ") AS c(profile, position, provider, registered, max_retries))"
_ERRORS = {0: "rate_limit", 1: "server", 2: "transport", 3: "auth", 4: "bad_request"}
_ROUTED = f"""{_CHAINS_SQL}, lasts AS (SELECT *, max(position) OVER (PARTITION BY profile) AS last FROM chains), log AS (SELECT call_id, position, attempt, nullif(min(coalesce(error, '')), '') AS error FROM (SELECT l_orderkey AS call_id, (l_linenumber - 1) // 3 AS position, (l_linenumber - 1) % 3 AS attempt,
    CASE l_partkey % 7 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _ERRORS.items())} END AS error FROM lineitem) GROUP BY ALL),
  tries AS (SELECT o_orderkey AS call_id, lasts.position, provider, last, max_retries, r.attempt::BIGINT AS attempt, CASE WHEN l.call_id IS NULL THEN 'transport' ELSE error END AS error
    FROM orders JOIN lasts ON profile = o_orderpriority AND registered, range(0, 3) r(attempt) LEFT JOIN log l ON l.call_id = o_orderkey AND l.position = lasts.position AND l.attempt = r.attempt WHERE r.attempt <= max_retries),
  ends AS (SELECT *, min(CASE WHEN coalesce(error, '') NOT IN ('rate_limit', 'server', 'transport') OR attempt = max_retries THEN attempt END) OVER (PARTITION BY call_id, position) AS stop FROM tries),
  made AS (SELECT *, min(CASE WHEN attempt = stop AND (error IS NULL OR (error = 'auth' AND position = last)) THEN position END) OVER (PARTITION BY call_id) AS final FROM ends WHERE attempt <= stop),
  kept AS (SELECT * FROM made WHERE final IS NULL OR position <= final)"""


def _routed(spark, sf):
    shown = F.create_map(*(F.lit(x) for kv in _ERRORS.items() for x in kv))
    log = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("call_id"), F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("position"), ((F.col("l_linenumber") - 1) % 3).cast("int").alias("attempt"),
        shown[(F.col("l_partkey") % 7).cast("int")].alias("error"), (F.col("l_partkey") % 7).isin(0, 1).alias("retryable"))
    chains = spark.createDataFrame(_CHAINS, "profile string, position int, provider string, registered boolean, max_retries int")
    return B.route_calls(table(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("profile")), chains, log)


@query("m07_fallback", f"""WITH {_ROUTED}, found AS (SELECT call_id, max(CASE WHEN position = final AND attempt = stop THEN coalesce(error, 'succeeded') END) AS status, max(CASE WHEN position = final AND attempt = stop AND error IS NULL THEN provider END) AS provider,
    count(*) AS attempt_count, count(*) FILTER (attempt > 0) AS retry_count, coalesce(bool_or(position = final AND attempt = stop AND error IS NULL AND position > 0), false) AS fallback_used FROM kept GROUP BY call_id)
  SELECT o_orderkey AS call_id, coalesce(status, 'unavailable') AS status, provider, coalesce(attempt_count, 0) AS attempt_count, coalesce(retry_count, 0) AS retry_count, coalesce(fallback_used, false) AS fallback_used FROM orders LEFT JOIN found ON call_id = o_orderkey""")
def fallback(spark, sf):
    return _routed(spark, sf)[0]


@query("m07_attempt_log", f"WITH {_ROUTED} SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY position, attempt)::INT AS number, provider, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS status, error, coalesce(error, '') IN ('rate_limit', 'server', 'transport') AS retryable FROM kept")
def attempt_log(spark, sf):
    return _routed(spark, sf)[1]

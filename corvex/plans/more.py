"""The remaining operators: listings, set operations, payloads, versions, table groups, creation and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvex.functions import payload as Y
from corvex.operators import chunking as C
from corvex.operators import evaluation as V
from corvex.plans.base import CHUNKS_SQL, DOCS_SQL, LINES_SQL, chunks, documents, lines, query, table
from corvex.plans.evaluation import items
from corvex.plans.relational import JOBS_SQL, jobs


@query("b11_chunkable_blocks", f"WITH {LINES_SQL} SELECT document_id, order_index FROM lines WHERE order_index % 6 <> 5 AND trim(content) <> ''")
def chunkable_blocks(spark, sf):
    return lines(spark, sf).withColumn("excluded", F.col("order_index") % 6 == 5).where("NOT excluded AND trim(content) <> ''").select("document_id", "order_index")


@query("b15_recent_documents", f"WITH {DOCS_SQL} SELECT document_id, title, status FROM docs ORDER BY document_id DESC LIMIT 25")
def recent_documents(spark, sf):
    return documents(spark, sf).select("document_id", "title", "status").orderBy(F.desc("document_id")).limit(25)


@query("e18_usage_buckets", "SELECT event_type AS bucket, count(*) AS requests, round(sum(value), 4) AS tokens FROM events GROUP BY ALL")
def usage_buckets(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("tokens"))


@query("e23_run_records", """WITH t AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS by_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  r AS (SELECT *, CASE WHEN answer IS NULL THEN 'no answer' WHEN by_role <> 'assistant' THEN 'answered by ' || by_role END AS error FROM t)
  SELECT conv_id, turn, text AS question, conv_id % 5 <> 0 AS should_be_answerable, CASE WHEN error IS NULL THEN conv_id % 2 = 0 END AS top1_hit, CASE WHEN error IS NULL THEN turn % 3 <> 0 END AS top3_hit, CASE WHEN error IS NULL THEN 1 ELSE 0 END AS n_sections,
    CASE WHEN error IS NULL THEN answer ELSE '' END AS answer, CASE WHEN error IS NULL THEN length(answer) ELSE 0 END::BIGINT AS latency_ms, CASE WHEN error IS NULL THEN length(text) + length(answer) ELSE 0 END::BIGINT AS total_tokens,
    CASE WHEN error IS NULL THEN length(answer) / 1000 ELSE 0 END::DOUBLE AS estimated_cost_usd, error FROM r""")
def run_records(spark, sf):
    """Every turn as a question, the next turn as its answer, whole; a turn without one, or one that the user gives, is an error record."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("by", F.lead("role").over(w))
    error = F.when(F.col("answer").isNull(), "no answer").when(F.col("by") != "assistant", F.concat(F.lit("answered by "), "by"))
    size = lambda c: F.char_length(c).cast("long")
    record = V.run_record(
        F.col("text"), F.col("conv_id") % 5 != 0, F.col("answer"), F.array("role"), F.array(F.col("turn").cast("int")), F.array("conv_id"), F.col("conv_id") % 2 == 0, F.col("turn") % 3 != 0,
        size("answer"), (size("text"), size("answer")), size("answer") / 1000, error)
    r = t.select("conv_id", "turn", record.alias("r"))
    return r.select("conv_id", "turn", "r.question", "r.should_be_answerable", "r.retrieval.top1_hit", "r.retrieval.top3_hit", F.size("r.retrieval.retrieved_sections").alias("n_sections"), "r.answer", "r.latency_ms", "r.usage.total_tokens", "r.usage.estimated_cost_usd", "r.error")


@query("f06_list_ranks", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def list_ranks(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))


@query("g04_stable_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey) AS pos FROM lineitem")
def stable_order(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_linenumber", "l_partkey")).alias("pos"))


@query("h01_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf, "customer").select("c_nationkey")).distinct()


@query("h02_union_all", "SELECT s_nationkey AS k, 's' AS side FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer")
def union_all(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")).unionByName(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")))


@query("h03_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("h05_run_keys", "SELECT coalesce(a.user_id, b.user_id) AS user_id, a.user_id IS NOT NULL AND b.user_id IS NOT NULL AS both_runs FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') a FULL JOIN (SELECT DISTINCT user_id FROM events WHERE value > 20) b ON a.user_id = b.user_id")
def run_keys(spark, sf):
    e = table(spark, sf, "events")
    a, b = e.where("event_type = 'signup'").select("user_id").distinct().withColumn("a", F.lit(True)), e.where("value > 20").select("user_id").distinct().withColumn("b", F.lit(True))
    return a.join(b, "user_id", "full_outer").select("user_id", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_runs"))


@query("h06_warning_order", "SELECT user_id, list_aggregate(list(event_type ORDER BY f), 'string_agg', ',') AS warnings FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def warning_order(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda s: s["event_type"]), ",").alias("warnings"))


@query("i05_request_hash", """SELECT event_id, sha256('{"route":"' || event_type || '","user":"' || user_id || '","workspace":"w' || user_id % 5 || '"}') AS request_hash FROM events""")
def request_hash(spark, sf):
    entries = F.create_map(F.lit("workspace"), F.concat(F.lit("w"), F.col("user_id") % 5), F.lit("user"), F.col("user_id").cast("string"), F.lit("route"), "event_type")
    return table(spark, sf, "events").select("event_id", Y.request_hash(entries).alias("request_hash"))


@query("i10_section_names", f"WITH {CHUNKS_SQL} SELECT chunk_id, coalesce(CASE WHEN section > 0 THEN section_title END, CASE WHEN page_number > 3 THEN 'late' END, title) AS name FROM chunks")
def section_names(spark, sf):
    return chunks(spark, sf).select("chunk_id", F.coalesce(F.when(F.col("section") > 0, F.col("section_title")), F.when(F.col("page_number") > 3, "late"), "title").alias("name"))


@query("i25_plan_defaults")
def plan_defaults(spark, sf):
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"points": ["'), "event_type", F.lit('"], "sources": [1, 2]}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('Plan: {"sources": ['), "user_id", F.lit("]} end"))).otherwise("none")
    return table(spark, sf, "events").select("event_id", Y.read_plan(answer).alias("p"), Y.read_verification(answer).alias("v")).select("event_id", F.array_join("p.points", ",").alias("points"), F.array_join(F.col("p.sources").cast("array<string>"), ",").alias("sources"), "v.supported")


@query("i32_table_data")
def table_data(spark, sf):
    data = F.when(F.col("order_index") % 3 == 0, F.to_json(F.array(F.struct(F.col("order_index").alias("k"), F.col("content").alias("v"))))).when(F.col("order_index") % 3 == 1, F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("headers"), F.array(F.array("content")).alias("rows")))).otherwise("[[1, 2], [3, 4]]")
    return lines(spark, sf).select("document_id", "order_index", Y.table_data(data).alias("t")).select("document_id", "order_index", F.array_join("t.headers", ",").alias("headers"), "t.n_rows", F.array_join("t.first_row", ",").alias("first_row"))


@query("j06_algorithm_chunks", f"WITH {CHUNKS_SQL} SELECT chunk_id, 'Algorithm ' || (chunk_index // 9 + 1) AS algorithm_label, content FROM chunks WHERE content_kind = 'paragraph'")
def algorithm_chunks(spark, sf):
    return chunks(spark, sf).where("content_kind = 'paragraph'").select("chunk_id", F.concat(F.lit("Algorithm "), F.floor(F.col("chunk_index") / 9) + 1).alias("algorithm_label"), "content")


@query("j07_figure_chunks", f"WITH {CHUNKS_SQL}, f AS (SELECT chunk_id, content FROM chunks WHERE content_kind = 'equation') SELECT chunk_id, 'parent' AS role, content FROM f UNION ALL SELECT chunk_id, 'child', content FROM f")
def figure_chunks(spark, sf):
    f = chunks(spark, sf).where("content_kind = 'equation'").select("chunk_id", "content")
    return f.select("chunk_id", F.explode(F.array(F.lit("parent"), F.lit("child"))).alias("role"), "content")


@query("j12_chunk_metadata", f"WITH {CHUNKS_SQL} SELECT chunk_id, k, v FROM (SELECT chunk_id, unnest(['kind', 'page', 'section']) AS k, unnest([content_kind, page_number::VARCHAR, section_title]) AS v FROM chunks)")
def chunk_metadata(spark, sf):
    meta = F.create_map(F.lit("kind"), "content_kind", F.lit("page"), F.col("page_number").cast("string"), F.lit("section"), "section_title")
    return chunks(spark, sf).select("chunk_id", F.explode(meta).alias("k", "v"))


@query("j13_chunking_versions", f"WITH {CHUNKS_SQL} SELECT document_id, 'recursive-v1' AS version, count(DISTINCT node_id) AS parents, 0::BIGINT AS nodes FROM chunks GROUP BY ALL UNION ALL SELECT document_id, 'hybrid-graph-v1', count(DISTINCT node_id), count(DISTINCT node_id) + 1 FROM chunks GROUP BY ALL")
def chunking_versions(spark, sf):
    n = chunks(spark, sf).groupBy("document_id").agg(F.count_distinct("node_id").alias("n"))
    both = F.array(F.struct(F.lit("recursive-v1").alias("version"), F.col("n").alias("parents"), F.lit(0).cast("long").alias("nodes")), F.struct(F.lit("hybrid-graph-v1").alias("version"), F.col("n").alias("parents"), (F.col("n") + 1).alias("nodes")))
    return n.select("document_id", F.explode(both).alias("s")).select("document_id", "s.version", "s.parents", "s.nodes")


@query("j14_section_tree", f"WITH {CHUNKS_SQL}, s AS (SELECT document_id, section, any_value(section_title) AS section_title, count(*) AS n FROM chunks GROUP BY document_id, section) SELECT document_id, list_aggregate(list(section_title || ':' || n ORDER BY section), 'string_agg', ';') AS tree FROM s GROUP BY document_id")
def section_tree(spark, sf):
    s = chunks(spark, sf).groupBy("document_id", "section").agg(F.first("section_title").alias("t"), F.count("*").alias("n"))
    return s.groupBy("document_id").agg(C.ordered_text("section", F.concat("t", F.lit(":"), "n"), ";").alias("tree"))


@query("j15_embeddings")
def embeddings(spark, sf):
    return chunks(spark, sf).select("chunk_id", Y.hash_embedder()("content").alias("embedding"))


@query("j16_group_dispatch", f"WITH {CHUNKS_SQL} SELECT document_id, CASE content_kind WHEN 'table_row' THEN 'table' WHEN 'equation' THEN 'equation' ELSE 'prose' END AS builder, count(*) AS n FROM chunks GROUP BY ALL")
def group_dispatch(spark, sf):
    builder = F.when(F.col("content_kind") == "table_row", "table").when(F.col("content_kind") == "equation", "equation").otherwise("prose")
    return chunks(spark, sf).groupBy("document_id", builder.alias("builder")).agg(F.count("*").alias("n"))


@query("k02_item_conversion")
def item_conversion(spark, sf):
    from corvex.operators.pdf_items import classify_items

    return classify_items(items(spark, sf)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("k05_front_matter")
def front_matter(spark, sf):
    from corvex.operators.pdf_items import classify_items, merge_front_matter

    return merge_front_matter(classify_items(items(spark, sf))).where("kind = 'front_matter'").select("doc_id", "item_index", "text")


@query("k07_table_status", f"WITH {CHUNKS_SQL} SELECT document_id, section AS table_id, CASE WHEN count(*) FILTER (content_kind = 'table_row') > 0 THEN 'row_backed' ELSE 'caption_only' END AS status, count(*) FILTER (content_kind = 'table_row') AS n_rows FROM chunks GROUP BY document_id, section")
def table_status(spark, sf):
    n = F.count_if(F.col("content_kind") == "table_row")
    return chunks(spark, sf).groupBy("document_id", F.col("section").alias("table_id")).agg(F.when(n > 0, "row_backed").otherwise("caption_only").alias("status"), n.alias("n_rows"))


@query("l08_migration_ledger", "SELECT p_brand AS version, min(p_partkey) AS applied_at, row_number() OVER (ORDER BY p_brand) AS pos FROM part GROUP BY p_brand")
def migration_ledger(spark, sf):
    """Each version once, at its first row, in order; versions are few."""
    v = table(spark, sf, "part").groupBy(F.col("p_brand").alias("version")).agg(F.min("p_partkey").alias("applied_at"))
    return v.withColumn("pos", F.row_number().over(Window.orderBy("version")))


@query("l09_created_rows", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'given-' || event_id END, sha256(event_type || '|' || event_id)) AS id, 'queued' AS status, 1 AS attempt FROM events")
def created_rows(spark, sf):
    given = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("given-"), "event_id"))
    return table(spark, sf, "events").select("event_id", F.coalesce(given, F.sha2(F.concat_ws("|", "event_type", "event_id"), 256)).alias("id"), F.lit("queued").alias("status"), F.lit(1).alias("attempt"))


@query("l10_completed_claims", f"WITH {JOBS_SQL} SELECT job_id, status IN ('succeeded') AS stored, created_at + INTERVAL 24 HOUR AS expires_at FROM jobs WHERE status IN ('succeeded', 'retrying')")
def completed_claims(spark, sf):
    return jobs(spark, sf).where("status IN ('succeeded', 'retrying')").select("job_id", (F.col("status") == "succeeded").alias("stored"), (F.col("created_at") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))


@query("m10_ingestion_stages", f"WITH {CHUNKS_SQL} SELECT d.document_id, 'finalize' AS stage, count(c.chunk_id) AS chunks_n, sum(length(c.content))::BIGINT AS chars_n FROM docs d LEFT JOIN chunks c USING (document_id) GROUP BY d.document_id")
def ingestion_stages(spark, sf):
    """Extract, chunk and finalize as one plan; a stream runs the same per batch of new documents."""
    done = chunks(spark, sf).groupBy("document_id").agg(F.count("*").alias("chunks_n"), F.sum(F.char_length("content")).alias("chars_n"))
    return documents(spark, sf).select("document_id").join(done, "document_id", "left").select("document_id", F.lit("finalize").alias("stage"), F.coalesce("chunks_n", F.lit(0)).alias("chunks_n"), "chars_n")



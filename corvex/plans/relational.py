"""Filters, joins, windows, orderings, set operations and state tables over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvex.operators import access
from corvex.operators.state import fold_jobs, insert_ignore, partial_update, replace_by_key, upsert
from corvex.plans.base import CHUNKS_SQL, DOCS_SQL, LINES_SQL, chunks, documents, lines, query, table

_RANK = "CASE sensitivity WHEN 'public' THEN 1 WHEN 'internal' THEN 2 WHEN 'confidential' THEN 3 WHEN 'restricted' THEN 4 ELSE 2 END"
MEMBERS_SQL = """members AS (SELECT 'user' || (c_custkey % 10) AS user_id, 'src' || (c_custkey % 20) AS workspace_id, CASE c_nationkey % 3 WHEN 0 THEN 'owner' ELSE 'member' END AS role,
  c_acctbal > 0 AS active, c_custkey AS joined FROM customer)"""


def members(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("user"), F.col("c_custkey") % 10).alias("user_id"), F.concat(F.lit("src"), F.col("c_custkey") % 20).alias("workspace_id"), F.when(F.col("c_nationkey") % 3 == 0, "owner").otherwise("member").alias("role"), (F.col("c_acctbal") > 0).alias("active"), F.col("c_custkey").alias("joined"))


JOBS_SQL = """jobs AS (SELECT event_id AS job_id, user_id % 50 AS document_id, 'user' || (user_id % 10) AS user_id, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'retrying' WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'processing' ELSE 'queued' END AS status FROM events)"""


def jobs(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "retrying").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "view", "processing").otherwise("queued")
    return e.select(F.col("event_id").alias("job_id"), (F.col("user_id") % 50).alias("document_id"), F.concat(F.lit("user"), F.col("user_id") % 10).alias("user_id"), F.col("ts").alias("created_at"), status.alias("status"))


# sources

@query("a01_inline_source", f"WITH {DOCS_SQL} SELECT document_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content, 0 AS order_index, 'paragraph' AS block_type, 'text' AS source_type FROM docs")
def inline_source(spark, sf):
    return documents(spark, sf).select("document_id", F.btrim("text", F.lit(" \t\n\r")).alias("content"), F.lit(0).alias("order_index"), F.lit("paragraph").alias("block_type"), F.lit("text").alias("source_type"))


@query("a04_source_type", """SELECT page_id, CASE WHEN f LIKE '%.md' THEN 'markdown' WHEN f LIKE '%.pdf' THEN 'pdf' WHEN f LIKE '%.docx' THEN 'docx' WHEN f LIKE '%.html' OR f LIKE '%.htm' OR m = 'text/html' THEN 'html' WHEN f LIKE '%.wav' OR m = 'audio/wav' THEN 'audio' END AS source_type
  FROM (SELECT page_id, lower('F' || page_id || (['.MD','.pdf','.docx','.htm','.wav','.bin'])[page_id % 6 + 1]) AS f, CASE WHEN page_id % 12 < 6 THEN 'text/html' ELSE 'audio/wav' END AS m FROM pages)""")
def source_type(spark, sf):
    from corvex.sources.formats import infer_source_type

    ending = F.element_at(F.array(*map(F.lit, (".MD", ".pdf", ".docx", ".htm", ".wav", ".bin"))), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", infer_source_type(F.concat(F.lit("F"), "page_id", ending), F.when(F.col("page_id") % 12 < 6, "text/html").otherwise("audio/wav")).alias("source_type"))


@query("a05_audio_format", """SELECT page_id, CASE WHEN e = 'mp4' THEN 'm4a' WHEN e IN ('wav','mp3','webm','ogg','m4a') THEN e WHEN m = 'audio/mpeg' THEN 'mp3' WHEN m = 'audio/x-wav' THEN 'wav' END AS format
  FROM (SELECT page_id, (['mp4','wav','ogg','xyz'])[page_id % 4 + 1] AS e, CASE WHEN page_id % 8 < 4 THEN 'audio/mpeg' ELSE 'audio/x-wav' END AS m FROM pages)""")
def audio_format(spark, sf):
    from corvex.sources.formats import infer_audio_format

    ending = F.element_at(F.array(*map(F.lit, ("mp4", "wav", "ogg", "xyz"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", infer_audio_format(F.concat(F.lit("f."), ending), F.when(F.col("page_id") % 8 < 4, "audio/mpeg").otherwise("audio/x-wav")).alias("format"))


@query("a11_audio_blocks", """WITH seg AS (SELECT conv_id, turn, role, text FROM conversations)
  SELECT conv_id, 0 AS order_index, 'heading' AS block_type, 'Audio Transcript' AS content, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms FROM seg GROUP BY conv_id
  UNION ALL SELECT conv_id, (turn + 1)::INT, 'paragraph', trim(text), turn * 1000, turn * 1000 + 900 FROM seg""")
def audio_blocks(spark, sf):
    from corvex.sources.audio import segments_to_blocks

    c = table(spark, sf, "conversations")
    segments = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("segment_index"), F.col("text"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 900).alias("end_ms"), F.col("role").alias("speaker")))).alias("segments"))
    return segments_to_blocks(segments, "conv_id").select("conv_id", "order_index", "block_type", "content", "start_ms", "end_ms")


# filters and predicates

@query("b01_child_scope", f"WITH {CHUNKS_SQL} SELECT chunk_id, content FROM chunks WHERE workspace_id = 'src3'")
def child_scope(spark, sf):
    return access.visible_chunks(chunks(spark, sf), workspace="src3").select("chunk_id", "content")


@query("b02_document_ids", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def document_ids(spark, sf):
    wanted = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"))
    return chunks(spark, sf).join(wanted, "document_id", "left_semi").select("chunk_id")


@query("b03_metadata_containment", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE content_kind = 'table_row' AND page_number IN (1, 2)")
def metadata_containment(spark, sf):
    metadata, _ = access.split_filters(access.sanitize_filters({"content_kind": "table_row", "page_number": [1, 2], "other": None, "document_ids": []}))
    return access.visible_chunks(chunks(spark, sf), metadata=metadata).select("chunk_id")


@query("b05_sensitivity_ceiling", f"WITH {CHUNKS_SQL} SELECT chunk_id, sensitivity FROM chunks WHERE {_RANK} <= 2")
def sensitivity_ceiling(spark, sf):
    return access.visible_chunks(chunks(spark, sf), ceiling="internal").select("chunk_id", "sensitivity")


@query("b07_document_list", f"WITH {DOCS_SQL} SELECT workspace_id, document_id, title FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY document_id DESC) AS rn FROM docs WHERE NOT deleted AND status = 'ready' AND source_type = 'markdown') WHERE rn <= 20")
def document_list(spark, sf):
    newest = Window.partitionBy("workspace_id").orderBy(F.desc("document_id"))
    return documents(spark, sf).where("NOT deleted AND status = 'ready' AND source_type = 'markdown'").withColumn("rn", F.row_number().over(newest)).where("rn <= 20").select("workspace_id", "document_id", "title")


@query("b08_point_lookups", f"WITH {DOCS_SQL}, {JOBS_SQL} SELECT job_id, j.document_id, j.status, d.title FROM jobs j JOIN docs d ON d.document_id = j.document_id WHERE j.user_id = 'user3' AND d.workspace_id = 'src13'")
def point_lookups(spark, sf):
    d = documents(spark, sf).where("workspace_id = 'src13'").select("document_id", "title")
    return jobs(spark, sf).where("user_id = 'user3'").join(d, "document_id").select("job_id", "document_id", "status", "title")


@query("b09_chunk_projection", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id, chunk_index, content, title, sensitivity, node_id, parent_node_id, section_title, page_number, content_kind, title || ' > ' || section_title AS section_path FROM chunks")
def chunk_projection(spark, sf):
    return chunks(spark, sf).select("chunk_id", "document_id", "chunk_index", "content", "title", "sensitivity", "node_id", "parent_node_id", "section_title", "page_number", "content_kind", F.concat_ws(" > ", "title", "section_title").alias("section_path"))


@query("b10_public_metadata", "SELECT event_id, k, v FROM (SELECT event_id, unnest(['type', '_user', 'value']) AS k, unnest([event_type, user_id::VARCHAR, event_type || '!']) AS v FROM events) WHERE k NOT LIKE '\\_%' ESCAPE '\\'")
def public_metadata(spark, sf):
    meta = F.create_map(F.lit("type"), "event_type", F.lit("_user"), F.col("user_id").cast("string"), F.lit("value"), F.concat("event_type", F.lit("!")))
    return table(spark, sf, "events").select("event_id", F.explode(F.map_filter(meta, lambda k, v: ~F.startswith(k, F.lit("_")))).alias("k", "v"))


@query("b12_min_length_gate", f"WITH {DOCS_SQL} SELECT document_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) BETWEEN 1 AND 19 AS should_skip FROM docs")
def min_length_gate(spark, sf):
    n = F.char_length(F.btrim("text", F.lit(" \t\n\r")))
    return documents(spark, sf).select("document_id", ((n > 0) & (n < 20)).alias("should_skip"))


@query("b13_highest_sensitivity", f"WITH {DOCS_SQL} SELECT workspace_id, lang, (['public','internal','confidential','restricted'])[max({_RANK})] AS highest, max({_RANK}) = 4 AND lang NOT IN ('en') AS refused FROM docs GROUP BY workspace_id, lang")
def highest(spark, sf):
    return access.highest_sensitivity(documents(spark, sf), ["workspace_id", "lang"]).withColumn("refused", (F.col("highest") == "restricted") & ~F.col("lang").isin("en"))


@query("b14_empty_diagnosis", f"WITH {CHUNKS_SQL}, q AS (SELECT item_id, lower(split_part(text, ' ', 1)) AS term FROM benchmark) SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM chunks c WHERE {_RANK} <= 2 AND lower(split_part(content, ' ', 1)) = term) THEN 'matched' ELSE 'no_match' END AS outcome FROM q")
def empty_diagnosis(spark, sf):
    first = lambda c: F.lower(F.split_part(c, F.lit(" "), F.lit(1)))
    q = table(spark, sf, "benchmark").select("item_id", first(F.col("text")).alias("term"))
    heads = access.visible_chunks(chunks(spark, sf), ceiling="internal").select(first(F.col("content")).alias("term")).distinct().withColumn("hit", F.lit(True))
    return q.join(heads, "term", "left").select("item_id", F.when(F.col("hit"), "matched").otherwise("no_match").alias("outcome"))


# joins

@query("c01_chunk_document_join", f"WITH {DOCS_SQL}, c AS (SELECT conv_id, turn, conv_id AS document_id FROM conversations) SELECT conv_id, turn, title, sensitivity FROM c JOIN docs USING (document_id)")
def chunk_document_join(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("conv_id").alias("document_id"))
    return c.join(documents(spark, sf).select("document_id", "title", "sensitivity"), "document_id").select("conv_id", "turn", "title", "sensitivity")


@query("c02_child_count", f"WITH {LINES_SQL} SELECT d.document_id, count(l.order_index) FILTER (l.order_index % 2 = 0) AS n FROM docs d LEFT JOIN lines l USING (document_id) GROUP BY d.document_id")
def child_count(spark, sf):
    counted = lines(spark, sf).groupBy("document_id").agg(F.count_if(F.col("order_index") % 2 == 0).alias("n"))
    return documents(spark, sf).select("document_id").join(counted, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("c03_conversation_messages", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'user')")
def conversation_messages(spark, sf):
    c = table(spark, sf, "conversations")
    owned = c.where("turn = 0 AND role = 'user'").select("conv_id").distinct()
    return c.join(owned, "conv_id", "left_semi").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("pos"))


@query("c04_user_jobs", f"WITH {DOCS_SQL}, {JOBS_SQL} SELECT user_id, job_id, status, title FROM (SELECT j.user_id, job_id, j.status, title, row_number() OVER (PARTITION BY j.user_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs j JOIN docs USING (document_id)) WHERE rn <= 200")
def user_jobs(spark, sf):
    joined = jobs(spark, sf).join(documents(spark, sf).select("document_id", "title"), "document_id")
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return joined.withColumn("rn", F.row_number().over(newest)).where("rn <= 200").select("user_id", "job_id", "status", "title")


@query("c05_primary_workspace", f"WITH {MEMBERS_SQL} SELECT user_id, arg_min(workspace_id, joined) AS workspace_id, count(DISTINCT workspace_id) AS n FROM members WHERE active GROUP BY user_id")
def primary_workspace(spark, sf):
    return members(spark, sf).where("active").groupBy("user_id").agg(F.min_by("workspace_id", "joined").alias("workspace_id"), F.count_distinct("workspace_id").alias("n"))


@query("c06_secure_view", f"WITH {DOCS_SQL}, {MEMBERS_SQL} SELECT document_id FROM docs d WHERE EXISTS (SELECT 1 FROM members m WHERE m.workspace_id = d.workspace_id AND m.user_id = 'user3' AND active)")
def secure_view(spark, sf):
    return access.secure_view(documents(spark, sf), members(spark, sf), "user3").select("document_id")


@query("c07_group_rule", f"WITH {DOCS_SQL}, acl AS (SELECT document_id, document_id % 6 AS group_id FROM docs WHERE document_id % 4 = 0) SELECT document_id FROM docs WHERE document_id NOT IN (SELECT document_id FROM acl) OR document_id IN (SELECT document_id FROM acl WHERE group_id IN (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 3))")
def group_rule(spark, sf):
    d = documents(spark, sf).select("document_id")
    entries = d.where("document_id % 4 = 0").select("document_id", (F.col("document_id") % 6).alias("group_id"))
    return access.group_visible(d, entries, table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_regionkey").alias("group_id")))


@query("c08_neighbours", f"WITH {CHUNKS_SQL}, linked AS (SELECT chunk_id, document_id, chunk_index, content_kind, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS nxt FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)), seeds AS (SELECT * FROM linked WHERE content_kind = 'equation') SELECT chunk_id FROM chunks WHERE chunk_id IN (SELECT prev FROM seeds UNION SELECT nxt FROM seeds)")
def neighbours(spark, sf):
    from corvex.operators.graph import link_chunks

    linked = link_chunks(chunks(spark, sf).select("chunk_id", "document_id", "chunk_index", "content_kind"))
    seeds = linked.where("content_kind = 'equation'")
    ids = seeds.select(F.col("previous_chunk_id").alias("chunk_id")).union(seeds.select("next_chunk_id")).where("chunk_id IS NOT NULL").distinct()
    return linked.join(ids, "chunk_id", "left_semi").select("chunk_id")


NODES_SQL = CHUNKS_SQL + """, nodes AS (SELECT node_id, any_value(document_id) AS parent_node_id, min(chunk_index) AS block_order, any_value(document_id) AS document_id FROM chunks GROUP BY node_id)"""


@query("c09_siblings", f"WITH {NODES_SQL} SELECT s.node_id AS seed, n.node_id AS sibling FROM nodes s JOIN nodes n ON n.parent_node_id = s.parent_node_id AND n.node_id <> s.node_id WHERE s.block_order = 0")
def siblings(spark, sf):
    from corvex.operators.graph import sections, siblings_of

    nodes = sections(chunks(spark, sf))
    return siblings_of(nodes.where("block_order = 0"), nodes).select("seed", "sibling")


@query("c10_ancestors", f"WITH RECURSIVE {CHUNKS_SQL}, edges AS (SELECT 'chunk ' || chunk_id AS id, 'node ' || node_id AS parent FROM chunks UNION SELECT 'node ' || node_id, 'document ' || parent_node_id FROM chunks), walk AS (SELECT id AS seed, id, 0 AS depth FROM edges WHERE id LIKE 'chunk %' UNION ALL SELECT seed, parent, depth + 1 FROM walk JOIN edges USING (id) WHERE depth < 2) SELECT DISTINCT seed, id AS ancestor, depth FROM walk WHERE depth > 0")
def ancestors(spark, sf):
    from corvex.operators.graph import ancestors_of

    c = chunks(spark, sf)
    named = lambda kind, column: F.concat(F.lit(f"{kind} "), column)
    edges = c.select(named("chunk", "chunk_id").alias("id"), named("node", "node_id").alias("parent")).union(c.select(named("node", "node_id"), named("document", "parent_node_id"))).distinct()
    return ancestors_of(edges.where("id LIKE 'chunk %'").select("id"), edges, 2)


@query("c11_parent_context", f"WITH {CHUNKS_SQL}, parents AS (SELECT node_id, arg_max(content, chunk_index) AS parent_content, arg_max(section_title, chunk_index) AS parent_section FROM chunks WHERE content_kind = 'paragraph' GROUP BY node_id) SELECT chunk_id, coalesce(parent_content, content) AS context FROM chunks LEFT JOIN parents USING (node_id)")
def parent_context(spark, sf):
    c = chunks(spark, sf)
    last = c.where("content_kind = 'paragraph'").groupBy("node_id").agg(F.max_by("content", "chunk_index").alias("parent_content"))
    return c.join(last, "node_id", "left").select("chunk_id", F.coalesce("parent_content", "content").alias("context"))


@query("c13_nearest_caption", f"""WITH {CHUNKS_SQL}, rows_ AS (SELECT chunk_id, document_id, chunk_index, section, page_number FROM chunks WHERE content_kind = 'table_row'), caps AS (SELECT chunk_id AS caption_id, document_id, chunk_index AS cap_index, section AS cap_section FROM chunks WHERE content_kind = 'equation')
  SELECT chunk_id, caption_id FROM (SELECT chunk_id, caption_id, row_number() OVER (PARTITION BY chunk_id ORDER BY cap_index > chunk_index, CASE WHEN section = cap_section THEN 0 ELSE 1 END, abs(cap_index - chunk_index), caption_id) AS rn FROM rows_ JOIN caps USING (document_id)) WHERE rn = 1""")
def nearest_caption(spark, sf):
    from corvex.operators.pdf_items import nearest_captions

    c = chunks(spark, sf).select("document_id", "chunk_id", "chunk_index", "section", "content_kind")
    rows, captions = c.where("content_kind = 'table_row'"), c.where("content_kind = 'equation'").select(F.col("chunk_id").alias("caption_id"), "document_id", F.col("chunk_index").alias("caption_index"), F.col("section").alias("caption_section"))
    return nearest_captions(rows, captions).select("chunk_id", "caption_id")


@query("c14_ids_lookup", f"WITH {CHUNKS_SQL} SELECT chunk_id, content FROM chunks WHERE node_id IN (SELECT node_id FROM chunks WHERE chunk_index = 7)")
def ids_lookup(spark, sf):
    c = chunks(spark, sf)
    return c.join(c.where("chunk_index = 7").select("node_id").distinct(), "node_id", "left_semi").select("chunk_id", "content")


@query("c16_feedback_insert", "SELECT conv_id, turn, role, 'up' AS rating FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'user')")
def feedback_insert(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where("role = 'assistant'").join(c.where("turn = 0 AND role = 'user'").select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn", "role", F.lit("up").alias("rating"))


@query("c17_access_checks", f"WITH {MEMBERS_SQL}, asked AS (SELECT DISTINCT user_id, 'src' || i AS workspace_id FROM members, range(20) r(i)) SELECT a.user_id, a.workspace_id, bool_or(coalesce(m.active, false)) AS allowed, max(m.role) FILTER (m.active) AS role FROM asked a LEFT JOIN members m USING (user_id, workspace_id) GROUP BY ALL")
def access_checks(spark, sf):
    m = members(spark, sf)
    asked = m.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("user_id", F.concat(F.lit("src"), "i").alias("workspace_id"))
    held = m.groupBy("user_id", "workspace_id").agg(F.bool_or("active").alias("allowed"), F.max(F.when(F.col("active"), F.col("role"))).alias("role"))
    return asked.join(held, ["user_id", "workspace_id"], "left").select("user_id", "workspace_id", F.coalesce("allowed", F.lit(False)).alias("allowed"), "role")


# windows, orderings, sets

@query("f01_linked_chunks", f"WITH {CHUNKS_SQL} SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY page_number, chunk_index)")
def linked_chunks(spark, sf):
    from corvex.operators.graph import link_chunks

    return link_chunks(chunks(spark, sf)).select("chunk_id", "previous_chunk_id", "next_chunk_id")


@query("f02_contiguous_groups", f"WITH {CHUNKS_SQL}, marked AS (SELECT *, CASE WHEN lag(content_kind) OVER w IS DISTINCT FROM content_kind OR lag(section) OVER w IS DISTINCT FROM section THEN 1 ELSE 0 END AS new FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)), grouped AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY chunk_index) AS g FROM marked) SELECT document_id, g::BIGINT AS group_number, any_value(content_kind) AS content_kind, count(*) AS n, min(chunk_index) AS first_index FROM grouped GROUP BY document_id, g")
def contiguous_groups(spark, sf):
    from corvex.operators.chunking import contiguous

    grouped = contiguous(chunks(spark, sf), "document_id", ["chunk_index"], ["content_kind", "section"], "group_number")
    return grouped.groupBy("document_id", "group_number").agg(F.first("content_kind").alias("content_kind"), F.count("*").alias("n"), F.min("chunk_index").alias("first_index"))


@query("f03_sibling_edges", f"WITH {NODES_SQL}, e AS (SELECT node_id, lead(node_id) OVER w AS nxt, lag(node_id) OVER w AS prv FROM nodes WINDOW w AS (PARTITION BY parent_node_id ORDER BY block_order, node_id)) SELECT node_id AS from_id, nxt AS to_id, 'next_sibling' AS edge_type FROM e WHERE nxt IS NOT NULL UNION ALL SELECT node_id, prv, 'previous_sibling' FROM e WHERE prv IS NOT NULL")
def sibling_edges(spark, sf):
    from corvex.operators.graph import sections, sibling_edges

    return sibling_edges(sections(chunks(spark, sf)))


@query("f04_running_index", f"WITH {CHUNKS_SQL} SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS i FROM chunks")
def running_index(spark, sf):
    return chunks(spark, sf).select("chunk_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1).cast("long").alias("i"))


@query("f05_heading_path", f"""WITH {LINES_SQL}, h AS (SELECT document_id, order_index, content, CASE WHEN order_index % 9 = 0 THEN 1 WHEN order_index % 3 = 0 THEN 2 END AS level FROM lines),
  g AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY order_index) AS top FROM h)
  SELECT document_id, order_index, last_value(CASE WHEN level = 1 THEN order_index END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY order_index ROWS UNBOUNDED PRECEDING) AS level1, last_value(CASE WHEN level = 2 THEN order_index END IGNORE NULLS) OVER (PARTITION BY document_id, top ORDER BY order_index ROWS UNBOUNDED PRECEDING) AS level2 FROM g""")
def heading_path(spark, sf):
    from corvex.operators.chunking import heading_stack

    level = F.when(F.col("order_index") % 9 == 0, 1).when(F.col("order_index") % 3 == 0, 2)
    return heading_stack(lines(spark, sf).select("document_id", "order_index", level.alias("level")), "document_id", "order_index", "level", "order_index", 2).select("document_id", "order_index", "level1", "level2")


@query("f07_header_carry", f"WITH {CHUNKS_SQL} SELECT chunk_id, last_value(CASE WHEN chunk_index % 6 = 0 THEN content END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS headers FROM chunks")
def header_carry(spark, sf):
    w = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks(spark, sf).select("chunk_id", F.last(F.when(F.col("chunk_index") % 6 == 0, F.col("content")), ignorenulls=True).over(w).alias("headers"))


@query("f08_nearest_siblings", f"WITH {NODES_SQL} SELECT seed, sibling FROM (SELECT s.node_id AS seed, n.node_id AS sibling, row_number() OVER (PARTITION BY s.node_id ORDER BY abs(n.block_order - s.block_order), n.block_order) AS rn FROM nodes s JOIN nodes n ON n.parent_node_id = s.parent_node_id AND n.node_id <> s.node_id) WHERE rn <= 2")
def nearest_siblings(spark, sf):
    from corvex.operators.graph import nearest_siblings, sections

    return nearest_siblings(sections(chunks(spark, sf))).select("seed", "sibling")


@query("g01_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("g02_nulls_last", f"WITH {CHUNKS_SQL} SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN content_kind = 'table_row' THEN NULL ELSE page_number END NULLS LAST, CASE content_kind WHEN 'equation' THEN 0 ELSE 1 END, chunk_index) AS pos FROM chunks")
def nulls_last(spark, sf):
    w = Window.partitionBy("document_id").orderBy(F.asc_nulls_last(F.when(F.col("content_kind") != "table_row", F.col("page_number"))), F.when(F.col("content_kind") == "equation", 0).otherwise(1), "chunk_index")
    return chunks(spark, sf).select("chunk_id", F.row_number().over(w).alias("pos"))


@query("g03_latest_by_title", f"WITH {DOCS_SQL} SELECT lang, workspace_id, arg_max(title, document_id) AS title FROM docs GROUP BY lang, workspace_id")
def latest_by_title(spark, sf):
    return documents(spark, sf).groupBy("lang", "workspace_id").agg(F.max_by("title", "document_id").alias("title"))


@query("h04_term_sets", f"WITH {LINES_SQL}, t AS (SELECT document_id, order_index, list_distinct(list_filter(string_split(lower(content), ' '), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split(lower(title), ' '), lambda w: w <> '')) AS b FROM lines) SELECT document_id, order_index, len(list_intersect(a, b))::INT AS both_n, len(list_distinct(list_concat(a, b)))::INT AS any_n, (len(a) - len(list_intersect(a, b)))::INT AS only_n FROM t")
def term_sets(spark, sf):
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != ""))
    t = lines(spark, sf).select("document_id", "order_index", split("content").alias("a"), split("title").alias("b"))
    return t.select("document_id", "order_index", F.size(F.array_intersect("a", "b")).alias("both_n"), F.size(F.array_union("a", "b")).alias("any_n"), F.size(F.array_except("a", "b")).alias("only_n"))


# state tables

@query("l01_replace_by_document", f"WITH {LINES_SQL}, fresh AS (SELECT document_id, order_index, 'fresh ' || content AS content FROM lines WHERE document_id IN (SELECT document_id FROM docs WHERE status = 'processing')) SELECT document_id, order_index, content FROM lines WHERE document_id NOT IN (SELECT document_id FROM fresh) UNION ALL SELECT * FROM fresh")
def replace_by_document(spark, sf):
    old = lines(spark, sf).select("document_id", "order_index", "content")
    return replace_by_key(old, old.join(documents(spark, sf).where("status = 'processing'"), "document_id", "left_semi").withColumn("content", F.concat(F.lit("fresh "), "content")), ["document_id"])


@query("l02_upsert", "SELECT c_custkey, coalesce(n.v, o.v) AS v FROM (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_acctbal >= 0) o FULL JOIN (SELECT c_custkey, 'new' AS v FROM customer WHERE c_mktsegment = 'BUILDING') n USING (c_custkey)")
def upsert_rows(spark, sf):
    c = table(spark, sf, "customer")
    return upsert(c.where("c_acctbal >= 0").select("c_custkey", F.col("c_mktsegment").alias("v")), c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("new").alias("v")), ["c_custkey"])


@query("l03_insert_ignore", "SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def insert_ignore_rows(spark, sf):
    c = table(spark, sf, "customer")
    return insert_ignore(c.where("c_acctbal >= 0").select("c_custkey", F.col("c_mktsegment").alias("v")), c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("new").alias("v")), ["c_custkey"])


@query("l05_job_state", f"WITH {JOBS_SQL} SELECT document_id, arg_max(status, (created_at, job_id)) AS status, min(created_at) FILTER (status = 'processing') AS started_at, max(created_at) FILTER (status IN ('succeeded', 'dead_letter', 'failed', 'cancelled')) AS finished_at, count(*) FILTER (status = 'retrying') AS attempts FROM jobs GROUP BY document_id")
def job_state(spark, sf):
    return fold_jobs(jobs(spark, sf), "document_id")


@query("l06_partial_update", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'N' || p_partkey ELSE p_name END AS p_name, p_brand FROM part")
def partial_update_rows(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    patch = p.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("N"), "p_partkey")).alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    return partial_update(p, patch, ["p_partkey"])


@query("l07_append_logs", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, sum(length(text)) FILTER (role = 'assistant') AS completion_chars FROM conversations GROUP BY conv_id")
def append_logs(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.sum(F.when(F.col("role") == "assistant", F.char_length("text"))).alias("completion_chars"))


@query("m06_retry_fold", f"WITH {JOBS_SQL}, a AS (SELECT document_id, job_id, created_at, row_number() OVER (PARTITION BY document_id ORDER BY created_at, job_id) AS attempt FROM jobs WHERE status = 'retrying') SELECT document_id, attempt, CASE WHEN attempt >= 3 THEN 'dead_letter' ELSE 'retrying' END AS outcome, CASE WHEN attempt < 3 THEN (30 * attempt)::INT END AS backoff_s FROM a WHERE attempt <= 3")
def retry_fold(spark, sf):
    w = Window.partitionBy("document_id").orderBy("created_at", "job_id")
    a = jobs(spark, sf).where("status = 'retrying'").withColumn("attempt", F.row_number().over(w)).where("attempt <= 3")
    return a.select("document_id", "attempt", F.when(F.col("attempt") >= 3, "dead_letter").otherwise("retrying").alias("outcome"), F.when(F.col("attempt") < 3, 30 * F.col("attempt")).alias("backoff_s"))


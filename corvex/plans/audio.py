"""Audio retrieval over conversations as transcripts: a turn is a segment; every benchmark item asks for its longest words."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvex.functions import features as Q
from corvex.functions import text as T
from corvex.operators import audio_search as A
from corvex.operators import lexical as L
from corvex.operators import search as S
from corvex.plans.base import query, table
from corvex.plans.lexical import LEX_SQL

_K = 4
_SQL = f"""asked AS (SELECT item_id AS query_id, l[1] || ' or ' || l[2] || CASE WHEN item_id % 3 = 0 THEN ' or 42' ELSE '' END AS question FROM (
    SELECT item_id, list_transform(list_sort(list_distinct(list_transform(list_filter(string_split_regex(text, '{T.WS}+'), lambda w: w <> ''), lambda x: [lpad((1000 - length(x))::VARCHAR, 4, '0'), x]))), lambda y: y[2]) AS l FROM benchmark) WHERE len(l) >= 2),
  questions AS (SELECT * FROM asked),
  chunks AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS document_id, turn::INT AS chunk_index, text AS content, CASE WHEN turn % 4 <> 3 THEN turn * 1500 END AS start_ms, CASE WHEN turn % 4 < 2 THEN turn * 1500 + 1000 END AS end_ms FROM conversations),
  {LEX_SQL},
  near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT a.query_id, c.chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM asked a JOIN embeddings q ON q.vec_id = a.query_id, chunks c JOIN embeddings e ON e.vec_id = c.document_id * 2 + c.chunk_index)),
  sides AS (SELECT query_id, chunk_id, v.rank AS vr, l.rank AS lr FROM (SELECT * FROM near WHERE rank <= {A.side_limit(_K)}) v FULL JOIN (SELECT query_id, chunk_id, rank FROM lex WHERE rank <= {A.side_limit(_K)}) l USING (query_id, chunk_id)),
  merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vr NULLS LAST, lr NULLS LAST, chunk_id) AS fused_rank FROM (SELECT *, round(coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(0.85::DOUBLE / (60 + lr), 0), 8) AS fused FROM sides)),
  boosted AS (SELECT query_id, chunk_id, fused_rank, p, n, round(fused + 0.05::DOUBLE + CASE WHEN start_ms IS NOT NULL AND end_ms IS NOT NULL THEN 0.02 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(question, '{Q.NUMBER}') AND start_ms IS NOT NULL THEN 0.01 ELSE 0 END::DOUBLE, 8) AS score
    FROM merged JOIN asked USING (query_id) JOIN (SELECT *, lag(chunk_id) OVER w AS p, lead(chunk_id) OVER w AS n FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)) USING (chunk_id)),
  seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS k FROM boosted) WHERE k <= {_K}),
  shown AS (SELECT query_id, k * 3 AS pos, chunk_id, 'primary_seed' AS role, score FROM seeds UNION ALL SELECT query_id, k * 3 + 1, p, 'local_support', greatest(round(score - 0.01, 8), 0.01) FROM seeds UNION ALL SELECT query_id, k * 3 + 2, n, 'local_support', greatest(round(score - 0.01, 8), 0.01) FROM seeds),
  first AS (SELECT query_id, chunk_id, min(pos) AS pos, arg_min(role, pos) AS role, arg_min(score, pos) AS score FROM shown WHERE chunk_id IS NOT NULL GROUP BY ALL)"""


def segments(spark, sf):
    t = table(spark, sf, "conversations")
    turn = F.col("turn")
    return t.select(
        (F.col("conv_id") * 1000 + turn).alias("chunk_id"), F.col("conv_id").alias("document_id"), turn.cast("int").alias("chunk_index"), F.col("text").alias("content"),
        F.when(turn % 4 != 3, turn * 1500).alias("start_ms"), F.when(turn % 4 < 2, turn * 1500 + 1000).alias("end_ms"))


def questions(spark, sf):
    w = F.array_distinct(T.words(F.col("text")))
    ordered = F.transform(F.array_sort(F.transform(w, lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x")))), lambda y: y["x"])
    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), ordered.alias("l")).where(F.size("l") >= 2)
    return t.select("query_id", F.concat(F.col("l")[0], F.lit(" or "), F.col("l")[1], F.when(F.col("query_id") % 3 == 0, " or 42").otherwise("")).alias("question"))


@query("d22_audio_context", f"WITH {_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS slot, chunk_id, role, score, greatest(1, len(list_filter(string_split_regex(content, '{T.WS}+'), lambda w: w <> '')))::INT AS tokens FROM first JOIN chunks USING (chunk_id)")
def audio_context(spark, sf):
    s, q, k = segments(spark, sf), questions(spark, sf), A.side_limit(_K)
    e = table(spark, sf, "embeddings")
    held = s.select("chunk_id", (F.col("document_id") * 2 + F.col("chunk_index")).alias("vec_id")).join(e, "vec_id").select(F.col("chunk_id").alias("vec_id"), "embedding")
    asked = q.join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id").select("query_id", "vector")
    near = S.vector_top_k(asked, held, k).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")
    text = L.search_top_k(q, s, k).select("query_id", "chunk_id", "rank")
    return A.audio_context(q, s, near, text, _K)

"""Retrieval of transcript segments: vector and text ranks fused, small boosts for timed segments, neighbours as support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.functions.features import query_features
from corvex.functions.text import token_count
from corvex.operators.graph import link_chunks
from corvex.operators.search import fuse

#: What a transcript segment, its times, and a number in the question add; what a neighbour's score lies below its seed's, and the least.
SEGMENT, TIMED, NUMBERED, STEP, LEAST = 0.05, 0.02, 0.01, 0.01, 0.01


def side_limit(top_k: int) -> int:
    """How many candidates each side gives."""
    return max(3 * top_k, 6)


def audio_context(questions: DataFrame, segments: DataFrame, vector: DataFrame, lexical: DataFrame, top_k: int = 4) -> DataFrame:
    """query_id, slot, chunk_id, role (primary_seed or local_support), score and tokens (words, at least one) of what answers each question.

    questions: query_id, question. segments: chunk_id, document_id, chunk_index, content, start_ms, end_ms. vector and
    lexical: query_id, chunk_id, rank, `side_limit(top_k)` at most of each question. The best top_k after the boosts are
    seeds (ties keep the fusion's order); each is followed by the segments before and after it in its document. Of repeated
    segments the first stays.
    """
    merged = fuse(vector, lexical).select("query_id", "chunk_id", "fused", F.col("rank").alias("fused_rank"))
    linked = link_chunks(segments)
    asked = questions.select("query_id", query_features(F.col("question"))["has_number"].alias("has_number"))
    timed = F.col("start_ms").isNotNull()
    boost = SEGMENT + F.when(timed & F.col("end_ms").isNotNull(), TIMED).otherwise(0.0) + F.when(F.col("has_number") & timed, NUMBERED).otherwise(0.0)
    scored = merged.join(linked.drop("content"), "chunk_id").join(asked, "query_id").withColumn("score", F.round(F.col("fused") + boost, 8))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank")
    seeds = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top_k)
    below = F.greatest(F.round(F.col("score") - STEP, 8), F.lit(LEAST))
    part = lambda at, chunk, role, score: F.struct(F.lit(at).alias("at"), F.col(chunk).alias("chunk_id"), F.lit(role).alias("role"), score.alias("score"))
    every = F.array(part(0, "chunk_id", "primary_seed", F.col("score")), part(1, "previous_chunk_id", "local_support", below), part(2, "next_chunk_id", "local_support", below))
    shown = seeds.select("query_id", "n", F.explode(every).alias("x")).select("query_id", "n", "x.*").where("chunk_id IS NOT NULL")
    first = shown.groupBy("query_id", "chunk_id").agg(F.min(F.struct("n", "at", "role", "score")).alias("x")).select("query_id", "chunk_id", "x.*")
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("n", "at"))
    return first.withColumn("slot", slot).join(segments.select("chunk_id", token_count(F.col("content")).alias("tokens")), "chunk_id").select("query_id", "slot", "chunk_id", "role", "score", "tokens")

"""Transcripts to segments and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.functions.text import confidence, milliseconds


def build_segments(transcripts: DataFrame, key: str) -> DataFrame:
    """key, segments and warnings from a transcription (transcript, raw_segments with text, start, end, speaker, avg_logprob, duration_ms).

    Blank segments go; without any left the whole transcript is the one segment, or there is none.
    """
    numbered = F.transform("raw_segments", lambda s, i: F.struct(
        i.alias("segment_index"), F.btrim(s["text"]).alias("text"), milliseconds(s["start"]).alias("start_ms"), milliseconds(s["end"]).alias("end_ms"), s["speaker"].alias("speaker"), confidence(s["avg_logprob"]).alias("confidence")))
    built = F.filter(numbered, lambda s: s["text"] != "")
    whole = F.array(F.struct(
        F.lit(0).alias("segment_index"), F.btrim("transcript").alias("text"), F.when(F.col("duration_ms").isNotNull(), F.lit(0)).cast("long").alias("start_ms"), F.col("duration_ms").cast("long").alias("end_ms"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("confidence")))
    has, text = F.size("built") > 0, F.btrim("transcript") != ""
    untimed = F.exists("built", lambda s: s["start_ms"].isNull() | s["end_ms"].isNull())
    ready = transcripts.withColumn("built", built)
    warning = F.when(has & untimed, "segments without timestamps").when(~has & text, "no segments: one for the whole transcript").when(~has, "empty transcript")
    return ready.select(key, F.when(has, F.col("built")).when(text, whole).otherwise(F.slice(whole, 1, 0)).alias("segments"), F.array_compact(F.array(warning)).alias("warnings"))


def segments_to_blocks(transcripts: DataFrame, key: str) -> DataFrame:
    """A heading and one paragraph per segment of the array column segments."""
    head = transcripts.select(key, F.lit(0).alias("order_index"), F.lit("heading").alias("block_type"), F.lit("Audio Transcript").alias("content"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit(None).cast("string").alias("speaker"))
    body = transcripts.select(key, F.posexplode("segments").alias("at", "s")).select(key, (F.col("at") + 1).alias("order_index"), F.lit("paragraph").alias("block_type"), F.trim("s.text").alias("content"), F.col("s.start_ms").cast("long").alias("start_ms"), F.col("s.end_ms").cast("long").alias("end_ms"), "s.speaker")
    return head.unionByName(body)

"""Source formats: inference from names and media types, blobs, datasets, sinks."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO_TYPES = {"audio/wav": "wav", "audio/x-wav": "wav", "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/webm": "webm", "audio/ogg": "ogg", "audio/mp4": "m4a", "audio/x-m4a": "m4a"}
AUDIO_ENDINGS = ("wav", "mp3", "webm", "ogg", "m4a", "mp4")
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
GOLDEN = "question string, expected_answer string, difficulty string, required_document_ids array<string>, acceptable_chunk_ids array<string>, expected_section_path array<string>, expected_page_number int, expected_chunk_type string"


def infer_source_type(filename: Column, media_type: Column) -> Column:
    """The parser for an upload, by ending or media type, in this order; null for none."""
    name = F.lower(filename)
    ends = lambda *e: F.rlike(name, F.lit(r"\.(" + "|".join(e) + ")$"))
    return (
        F.when(ends("md") | (media_type == "text/markdown"), "markdown").when(ends("pdf") | (media_type == "application/pdf"), "pdf").when(ends("docx") | (media_type == WORD_TYPE), "docx")
        .when(ends("html", "htm") | (media_type == "text/html"), "html").when(ends(*AUDIO_ENDINGS) | media_type.isin(*AUDIO_TYPES), "audio")
    )


def infer_audio_format(filename: Column, media_type: Column) -> Column:
    ending = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    by_type = F.lit(None).cast("string")
    for kind, name in AUDIO_TYPES.items():
        by_type = F.when(media_type == kind, name).otherwise(by_type)
    return F.when(ending == "mp4", "m4a").when(ending.isin(*AUDIO_ENDINGS), ending).otherwise(by_type)


def wav_duration_ms(blobs: DataFrame, column: str = "content") -> DataFrame:
    """blobs with duration_ms, frames over rate; null for what is no WAV."""

    def duration(raw: bytes | None) -> float | None:
        try:
            with wave.open(io.BytesIO(raw or b"")) as w:
                return w.getnframes() * 1000 // w.getframerate() if w.getframerate() else None
        except (wave.Error, EOFError):
            return None

    @F.pandas_udf("long")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(duration).astype("Int64")

    return blobs.withColumn("duration_ms", run(column))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of files; an object that is missing or pending fails in Spark's reader."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation set; a missing file is an empty set."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], GOLDEN)
    return spark.read.schema(GOLDEN).json(path, multiLine=True)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of a run file."""
    schema = "questions array<struct<question_id string, answer string, latency_ms double, retrieval struct<top1_hit boolean, top3_hit boolean>, metadata struct<query_class string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")


def write_scores(rows: DataFrame, path: str) -> None:
    """CSV with a header, lists joined by bars."""
    flat = [F.array_join(c, " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_processed_text(rows: DataFrame, path: str) -> None:
    """One text file set per workspace and document."""
    rows.select("workspace_id", "document_id", "text").write.mode("overwrite").partitionBy("workspace_id", "document_id").text(path)


def parse_documents(raw: DataFrame) -> DataFrame:
    """Blocks of raw documents (document_id, source_type, content binary), each by the parser of its type; a type without one fails."""
    from corvex.sources.parsers import PARSERS

    schema = "document_id {}, order_index int, block_type string, content string, level int, section_path array<string>, metadata map<string,string>".format(dict(raw.dtypes)["document_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, kind, content in zip(batch["document_id"], batch["source_type"], batch["content"]):
                if kind not in PARSERS:
                    raise ValueError(f"unsupported source type {kind!r}")
                rows += [(number, i, b["block_type"], b["content"], b.get("level"), b["section_path"], b["metadata"]) for i, b in enumerate(PARSERS[kind](bytes(content or b"")))]
            yield pd.DataFrame(rows, columns=["document_id", "order_index", "block_type", "content", "level", "section_path", "metadata"]).astype({"level": "Int32"})

    return raw.select("document_id", "source_type", "content").mapInPandas(run, schema)

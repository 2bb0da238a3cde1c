"""Ingestion of a stream of document files: extract, chunk, finalize, a batch at a time, replayable at any point.

Every stage of a batch is a folder of its own (`<root>/<stage>/batch=<n>`), written whole and overwritten by a replay; a
batch counts once its last stage, the status of its documents, is written, so what a killed batch has left is never seen. A
document's newest finished batch holds its chunks: a later version replaces an earlier one. A document that cannot be parsed
waits, with its content, for a later batch (one batch after the first failure, two after the second, and so on),
and is a dead letter after its last attempt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvex.sources.formats import infer_source_type

FILES = "path string, modificationTime timestamp, length long, content binary"
RAW = "document_id string, source_type string, content binary, attempt int"
BLOCKS = "document_id string, attempt int, order_index int, block_type string, content string, section_path array<string>, error string"
PENDING = RAW + ", due long"
STATUS = "document_id string, status string, attempt int, n_chunks long, n_chars long, error string"
STAGES = ("extract", "chunk", "pending", "finalize")


class Ingestion:
    """root: a folder that all executors see. most: attempts of a document. after: called with the stage and batch as each stage is done."""

    def __init__(self, spark: SparkSession, root: str, most: int = 3, after: Callable[[str, int], None] = lambda stage, batch: None):
        self.spark, self.root, self.most, self.after = spark, root, most, after

    def _write(self, df: DataFrame, stage: str, batch: int) -> DataFrame:
        path = f"{self.root}/{stage}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        self.after(stage, batch)
        return self.spark.read.schema(df.schema).parquet(path)

    def _waiting(self, batch: int) -> DataFrame:
        """What the batch before left waiting."""
        try:
            return self.spark.read.schema(PENDING).parquet(f"{self.root}/pending/batch={batch - 1}")
        except AnalysisException:  # no batch before
            return self.spark.createDataFrame([], PENDING)

    def run_batch(self, files: DataFrame, batch: int) -> None:
        """One batch of files (document_id, source_type, content, version: the greatest of a document counts)."""
        newest = Window.partitionBy("document_id").orderBy(F.desc("version"))
        fresh = files.withColumn("n", F.row_number().over(newest)).where("n = 1").select(F.col("document_id").cast("string"), "source_type", "content", F.lit(1).alias("attempt"))
        waiting = self._waiting(batch).join(fresh.select("document_id"), "document_id", "left_anti")
        due = waiting.where(F.col("due") <= batch).select("document_id", "source_type", "content", (F.col("attempt") + 1).alias("attempt"))
        work = fresh.unionByName(due)
        blocks = self._write(work.mapInPandas(_extract, BLOCKS), "extract", batch)
        path = F.array_join("section_path", " > ")
        body = blocks.where("error IS NULL AND block_type <> 'heading'").select(
            "document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("order_index")).alias("chunk_index"), F.col("block_type").alias("content_kind"), path.alias("section_path"), "content")
        chunks = self._write(body, "chunk", batch)
        failed = blocks.where("error IS NOT NULL").select("document_id", "error")
        again = work.join(failed.select("document_id"), "document_id", "left_semi").where(F.col("attempt") < self.most)
        later = again.withColumn("due", (F.lit(batch) + F.col("attempt")).cast("long"))
        self._write(waiting.where(F.col("due") > batch).unionByName(later), "pending", batch)
        sizes = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.char_length("content")).alias("n_chars"))
        state = F.when(F.col("error").isNull(), "ready").when(F.col("attempt") < self.most, "retrying").otherwise("dead")
        tried = work.select("document_id", "attempt").join(failed, "document_id", "left").join(sizes, "document_id", "left")
        self._write(tried.select("document_id", state.alias("status"), "attempt", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "error"), "finalize", batch)

    def start(self, source: str, checkpoint: str, **trigger):
        """The stream over the files of a folder: a file's name without its ending is the document, its ending the type. Spark passes over files without bytes."""
        files = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(source)
        name = F.element_at(F.split("path", "/"), -1)
        named = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("document_id"), infer_source_type(name, F.lit(None).cast("string")).alias("source_type"), "content", F.col("modificationTime").alias("version"))
        return named.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.run_batch).trigger(**(trigger or {"availableNow": True})).start()

    def statuses(self) -> DataFrame:
        """Each document's newest status, with the batch it comes from. Only finished batches have one."""
        every = self.spark.read.schema(STATUS + ", batch long").parquet(f"{self.root}/finalize")
        newest = Window.partitionBy("document_id").orderBy(F.desc("batch"))
        return every.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")

    def dead_letters(self) -> DataFrame:
        return self.statuses().where("status = 'dead'").select("document_id", "attempt", "error")

    def chunks(self) -> DataFrame:
        """The chunks of every document that has some, of its newest batch that could be read."""
        every = self.spark.read.schema(STATUS + ", batch long").parquet(f"{self.root}/finalize").where("status = 'ready'")
        newest = every.groupBy("document_id").agg(F.max("batch").alias("batch"))
        held = self.spark.read.schema("document_id string, chunk_index int, content_kind string, section_path string, content string, batch long").parquet(f"{self.root}/chunk")
        return held.join(newest, ["document_id", "batch"]).drop("batch")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each document, or one row with the error that its parser ends with; a document without blocks has one empty heading."""
    from corvex.sources.parsers import PARSERS

    columns = ["document_id", "attempt", "order_index", "block_type", "content", "section_path", "error"]
    for batch in batches:
        rows = []
        for number, kind, content, attempt in zip(batch["document_id"], batch["source_type"], batch["content"], batch["attempt"]):
            try:
                if kind not in PARSERS:
                    raise ValueError(f"unsupported source type {kind!r}")
                found = PARSERS[kind](bytes(content or b""))
                rows += [(number, attempt, i, b["block_type"], b["content"], b["section_path"], None) for i, b in enumerate(found)] or [(number, attempt, 0, "heading", "", [], None)]
            except Exception as error:  # any error of a parser is its document's, not the batch's
                rows.append((number, attempt, 0, None, None, None, f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(rows, columns=columns)

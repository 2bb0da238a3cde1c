"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens. Part of subpackage llm.

Every stage reads what its predecessor kept, written as Parquet between them, and all but the last return the columns of
documents, in their order, whatever further columns the table has, also where those are named like results of an operator.
For every stage: an empty table gives an empty table; a null text counts as the empty one; a row without an id is kept, as
no decision can name it, but for its lines, which it neither lends nor loses; rows that repeat an id are one document to
decisions, so they stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.llm.bpe import encode_documents
from corvex.llm.common import cut
from corvex.llm.decontamination import decontaminate
from corvex.llm.line_dedup import dedup_lines
from corvex.llm.quality import classify
from corvex.llm.simhash import near_duplicates

#: The near-dedup stage: a Jaccard similarity of 0.8 or more of the sets of five-word shingles. Fingerprints of 256 bits and 40
#: trees bring candidates together: at that similarity two differ in 39 bits on average, in over 60 hardly ever, and one of
#: the trees holds both with a probability of at least 0.99.
NEAR = {"width": 5, "size": 4, "distance": 60, "trees": 40, "bits": 13, "similarity": 0.8}


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these ids; rows without an id stay."""
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (junk, toxic) go; without labels the heuristics alone decide. Of rows that share an id all go if one is rejected."""
    return _without(docs, classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("NOT keep"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that a document with a smaller id holds goes; n_chars follows the text. A null text comes back empty."""
    aside = {c: f"__{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}  # the operator's results would replace these
    kept = dedup_lines(docs.withColumnsRenamed(aside)).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Texts of fewer than five words are compared whole; empty ones are copies of each other."""
    return _without(docs, near_duplicates(docs, **NEAR).where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; an empty benchmark or null items take nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their number and whether they decode to the text; an empty text has none and does."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "source", "lang", "n_tokens", "ids", "round_trip")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]
ORACLE_SQL = None  # learned and hashed decisions; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, which also holds labels and benchmark: doc_id, source, lang, n_tokens, ids, round_trip."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Registry of queries, and the corpus tables that they share: documents, lines (blocks) and chunks, in Spark and in SQL.

The given tables stand in for a workspace: a document's source is its workspace, doc_id gives creator, sensitivity, type
and deletion, a non-blank line is a block, five line positions are a section, and a line is a child chunk of its section.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.shared import written  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql is the equivalent for DuckDB."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    sensitivity = F.element_at(F.array(*map(F.lit, ("public", "internal", "confidential", "restricted"))), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("markdown", "html", "pdf", "docx", "text"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("workspace_id"), F.concat(F.lit("user"), F.col("doc_id") % 10).alias("created_by"), sensitivity.alias("sensitivity"),
        kind.alias("source_type"), F.when(F.col("doc_id") % 7 == 0, "processing").otherwise("ready").alias("status"), (F.col("doc_id") % 97 == 0).alias("deleted"),
        F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), "lang", "text",
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Non-blank lines with their position, trimmed of blanks."""
    d = documents(spark, sf).select("document_id", "workspace_id", "sensitivity", "deleted", "title", F.posexplode(F.split("text", "\n")).alias("order_index", "raw"))
    content = F.btrim("raw", F.lit(" \t\r"))
    return d.select("document_id", "workspace_id", "sensitivity", "deleted", "title", "order_index", content.alias("content")).where(F.col("content") != "")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Child chunks (one a line) of documents that are not deleted, with their section node and kind."""
    section = F.floor(F.col("order_index") / 5).cast("int")
    kind = F.when(F.col("order_index") % 7 == 3, "table_row").when(F.col("order_index") % 11 == 5, "equation").otherwise("paragraph")
    return lines(spark, sf).where("NOT deleted").select(
        (F.col("document_id") * 100000 + F.col("order_index")).alias("chunk_id"), "document_id", "workspace_id", "sensitivity", "title", F.col("order_index").alias("chunk_index"), "content",
        (F.col("document_id") * 100000 + section).alias("node_id"), F.col("document_id").alias("parent_node_id"), section.alias("section"), F.concat(F.lit("Section "), section).alias("section_title"),
        (section + 1).alias("page_number"), kind.alias("content_kind"),
    )


DOCS_SQL = """docs AS (
  SELECT doc_id AS document_id, source AS workspace_id, 'user' || (doc_id % 10) AS created_by,
    (['public','internal','confidential','restricted'])[doc_id % 4 + 1] AS sensitivity,
    (['markdown','html','pdf','docx','text'])[doc_id % 5 + 1] AS source_type,
    CASE WHEN doc_id % 7 = 0 THEN 'processing' ELSE 'ready' END AS status, doc_id % 97 = 0 AS deleted,
    'Document ' || doc_id AS title, lang, text FROM documents)"""
LINES_SQL = DOCS_SQL + """, split AS (
  SELECT document_id, workspace_id, sensitivity, deleted, title, unnest(string_split(text, chr(10))) AS raw,
    (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS order_index FROM docs),
lines AS (SELECT * EXCLUDE (raw), trim(raw, ' ' || chr(9) || chr(13)) AS content FROM split WHERE trim(raw, ' ' || chr(9) || chr(13)) <> '')"""
CHUNKS_SQL = LINES_SQL + """, chunks AS (
  SELECT document_id * 100000 + order_index AS chunk_id, document_id, workspace_id, sensitivity, title, order_index AS chunk_index, content,
    document_id * 100000 + order_index // 5 AS node_id, document_id AS parent_node_id, (order_index // 5)::INT AS section,
    'Section ' || (order_index // 5) AS section_title, (order_index // 5 + 1)::INT AS page_number,
    CASE WHEN order_index % 7 = 3 THEN 'table_row' WHEN order_index % 11 = 5 THEN 'equation' ELSE 'paragraph' END AS content_kind
  FROM lines WHERE NOT deleted)"""

"""Blocks to groups, sections and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contiguous(rows: DataFrame, key: str, order: list[str], same: list[str], out: str) -> DataFrame:
    """Number the runs of rows, within key and in order, whose columns `same` stay equal (from 1)."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    first = F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("__new", (new | first).cast("long")).withColumn(out, F.sum("__new").over(w)).drop("__new")


def heading_stack(rows: DataFrame, key: str, order: str, level: str, value: str, depth: int) -> DataFrame:
    """level1 .. level<depth>: the open heading of each level at each row; a heading closes those at its level and below."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.max(F.when(F.col(level) <= n, F.col(order))).over(w).alias(f"__open{n}") for n in range(1, depth + 1)),
                      *(F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(value).alias("v"))), ignorenulls=True).over(w).alias(f"__own{n}") for n in range(1, depth + 1)))
    out = out.withColumns({f"level{n}": F.when(F.col(f"__own{n}.at") == F.col(f"__open{n}"), F.col(f"__own{n}.v")) for n in range(1, depth + 1)})
    return out.drop(*(f"__open{n}" for n in range(1, depth + 1)), *(f"__own{n}" for n in range(1, depth + 1)))


def ordered_text(order: str, value: Column, joiner: str) -> Column:
    """Aggregate: values of a group joined in order. Groups here are sections, which are small."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]), joiner)


def parent_chunks(chunks: DataFrame) -> DataFrame:
    """One parent chunk per section: its path, then its blocks, blank lines between."""
    body = ordered_text("chunk_index", F.col("content"), "\n\n")
    return chunks.groupBy("document_id", "node_id").agg(F.first("title").alias("title"), F.first("section_title").alias("section_title"), body.alias("body"), F.count("*").alias("n_blocks")).select(
        "document_id", "node_id", "n_blocks", F.concat(F.concat_ws(" > ", "title", "section_title"), F.lit("\n\n"), "body").alias("content"))


def section_summaries(chunks: DataFrame, budget: int = 900, snippets: int = 3) -> DataFrame:
    """A section's header line and its first bodies, up to the budget of characters (the first always stays)."""
    w = Window.partitionBy("node_id").orderBy("chunk_index")
    header = F.concat(F.lit("Section: "), F.concat_ws(" > ", "title", "section_title"))
    text = F.when(F.col("content_kind") == "list_item", F.concat(F.lit("- "), "content")).otherwise(F.col("content"))
    sized = chunks.withColumn("header", header).withColumn("text", text).withColumn("n", F.row_number().over(w))
    sized = sized.withColumn("total", F.char_length("header") + F.sum(F.char_length("text")).over(w)).withColumn("fits", (F.col("n") == 1) | (F.col("total") <= budget))
    kept = sized.withColumn("open", F.min(F.col("fits").cast("int")).over(w) == 1).where(F.col("open") & (F.col("n") <= snippets))
    return kept.groupBy("node_id").agg(F.concat_ws("\n\n", F.first("header"), ordered_text("n", F.col("text"), "\n\n")).alias("summary"))


def table_chunks(chunks: DataFrame) -> DataFrame:
    """Row chunks of a section's table: caption, headers, row; the section's first block stands for the caption."""
    w = Window.partitionBy("node_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caption = F.first("content").over(w)
    return chunks.withColumn("caption", caption).where("content_kind = 'table_row'").select("chunk_id", F.concat_ws("\n", "caption", F.concat(F.lit("Row: "), F.btrim("content"))).alias("content"))


def embedding_text(title: Column, path: Column, node_type: Column, content: Column) -> Column:
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))
    return F.btrim(F.concat_ws("\n", line("Document: ", title), line("Section Path: ", path), line("Node Type: ", node_type), line("Content: ", content)), F.lit(" \n\t\r"))


def structure_nodes(chunks: DataFrame) -> DataFrame:
    """A node for every prefix of a section path, with block and page range grown over all below, and its parent."""
    path = F.array("title", "section_title")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))
    each = chunks.select("document_id", "chunk_index", "page_number", F.explode(prefixes).alias("path"))
    nodes = each.groupBy("document_id", "path").agg(F.min("chunk_index").alias("block_start"), F.max("chunk_index").alias("block_end"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    key = lambda p: F.md5(F.concat_ws("\x1f", F.col("document_id").cast("string"), F.array_join(p, " > ")))
    parent = F.when(F.size("path") > 1, key(F.slice("path", F.lit(1), F.size("path") - 1)))
    return nodes.select("document_id", key(F.col("path")).alias("node_key"), parent.alias("parent_key"), F.array_join("path", " > ").alias("path"), F.size("path").alias("level"), "block_start", "block_end", "page_start", "page_end")


def split_recursive(text: str, size: int = 900, overlap: int = 120, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most `size` characters: cut at the first separator that occurs, small pieces merged with some overlap, large ones cut further."""
    at = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(at) + 1 :] if at else ()
    parts = list(text) if at == "" else [p if i == 0 else at + p for i, p in enumerate(text.split(at))]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    for part in (p for p in parts if p):
        if len(part) > size and rest:
            flush()
            held.clear()
            out += split_recursive(part, size, overlap, rest)
            continue
        if held and sum(map(len, held)) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def split_chunks(parents: DataFrame, text_col: str = "content", size: int = 900, overlap: int = 120) -> DataFrame:
    """parents with piece and piece_index: whole below `size` words, else cut by split_recursive (Arrow batches)."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [t] if len(t.split()) < size else split_recursive(t, size, overlap))

    return parents.select("*", F.posexplode(cut(text_col)).alias("piece_index", "piece"))

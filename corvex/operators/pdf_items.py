"""Layout items of paged documents to blocks: ordered passes as windows, joins and conditions over the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvex.functions import text as T
from corvex.operators.chunking import contiguous, heading_stack
from corvex.operators.item_folds import merge_equations

SKIPPED = ("page_header", "page_footer")
HEADINGS = ("heading", "header", "section_header", "section", "subsection", "chapter", "abstract")


def classify_items(items: DataFrame) -> DataFrame:
    """kind of each item (doc_id, item_index, label, text, page_no): front matter before the first body heading, references after theirs, else by label and text."""
    w = Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, 0)
    ready = items.where(~T.is_blank(F.col("text")) & ~F.lower("label").isin(*SKIPPED)).withColumn("text", T.normalize_whitespace(F.col("text")))
    named = lambda change, name: (F.char_length("text") <= len(name)) & (change("text") == name)
    heading = F.lower("label").isin(*HEADINGS) | T.looks_like_heading(F.col("text"))
    body = F.max((F.col("heading") & T.is_structural_heading(F.col("text"))).cast("int")).over(w)
    references = F.max(named(F.upper, "REFERENCES").cast("int")).over(w)
    placed = ready.withColumn("heading", heading).withColumns({"in_body": body == 1, "in_references": references == 1})
    return placed.withColumn("kind", (
        F.when(named(F.upper, "REFERENCES") | named(F.lower, "abstract"), "heading").when(F.col("in_references"), "reference")
        .when(F.col("heading"), "heading").when(~F.col("in_body") & T.looks_like_front_matter(F.col("text")), "front_matter")
        .when(F.lower("label").isin("formula", "equation") | T.equation_shape(F.col("text")), "equation").when(F.rlike("text", F.lit(T.FIGURE_LABEL)), "figure_caption")
        .when(F.rlike("text", F.lit(T.TABLE_LABEL)), "table_caption").when(F.rlike("text", F.lit(T.ALGORITHM_LABEL)) | T.looks_like_algorithm_step(F.col("text")), "algorithm").otherwise("paragraph")))


def suppress_title(items: DataFrame, titles: DataFrame) -> DataFrame:
    """Without the first heading on the first page that repeats the title (doc_id, title)."""
    first = Window.partitionBy("doc_id").orderBy("item_index")
    same = (F.col("kind") == "heading") & (F.coalesce("page_no", F.lit(1)) == 1) & (F.lower("text") == F.lower(T.normalize_whitespace(F.col("title"))))
    marked = items.join(titles, "doc_id", "left").withColumn("__same", F.coalesce(same, F.lit(False)))
    marked = marked.withColumn("__nth", F.sum(F.col("__same").cast("int")).over(first))
    return marked.where(~(F.col("__same") & (F.col("__nth") == 1))).drop("__same", "__nth", "title")


def suppress_artifacts(items: DataFrame, titles: DataFrame) -> DataFrame:
    """Without runs of two or more banner-like lines that hold a marker or two title words."""
    tokens = lambda c: F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)
    short = F.col("text").isNull() | (F.char_length("text") <= 120)
    words, overlap = F.col("__words"), F.col("__overlap")
    capital = F.size(F.filter(words, lambda w: ~F.rlike(w, F.lit(r"^[\p{L}&&[^\p{Lu}]]"))))
    line = (F.char_length("text") <= 120) & (F.size(words) <= 10) & ((overlap >= 2) | (F.size(words) <= 7)) & (capital >= F.greatest(F.lit(2), F.size(words) - 2)) & ~T.looks_like_equation(F.col("text")) & ~T.looks_like_heading(F.col("text"))
    marker = T.one_of(F.lower("text"), ("version", "research division"))
    own = titles.select("doc_id", "title", T.title_tokens(F.coalesce("title", F.lit(""))).alias("__title"))
    joined = items.join(own, "doc_id", "left").withColumn("__marker", marker).withColumn("__words", F.when(short, T.words(F.col("text"))))
    # longer lines are only ever taken by a marker, which marks them as it is
    joined = joined.withColumn("__overlap", F.when(short & (F.size("__words") <= 10), F.size(F.array_intersect(tokens(F.col("text")), F.coalesce("__title", F.array().cast("array<string>"))))))
    marked = joined.withColumn("__line", F.col("__marker") | F.coalesce(line, F.lit(False))).withColumn("__mark", F.col("__marker") | F.coalesce(F.col("__line") & (overlap >= 2), F.lit(False))).drop("__words", "__overlap", "__title", "__marker")
    runs = contiguous(marked, "doc_id", ["item_index"], ["__line"], "__run")
    w = Window.partitionBy("doc_id", "__run")
    gone = F.col("__line") & (F.count("*").over(w) >= 2) & F.max(F.col("__mark").cast("int")).over(w).cast("boolean")
    return runs.withColumn("__gone", gone).where("NOT __gone").drop("__line", "__mark", "__run", "__gone", "title")


def promote_subsections(items: DataFrame) -> DataFrame:
    """Decimal-numbered paragraphs after the first body heading become headings."""
    w = Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, -1)
    body = F.coalesce(F.max((F.col("kind") == "heading").cast("int")).over(w), F.lit(0)) == 1
    text = F.col("text")
    fits = F.rlike(text, F.lit(T.DECIMAL_HEADING)) & (F.char_length(text) <= 140) & ~F.rlike(text, F.lit(r"[.?!]$")) & ~T.one_of(text, ("=", "|", "Table ", "Figure ", "Fig."))
    title = F.slice(T.words(F.regexp_extract(text, T.DECIMAL_HEADING, 2)), 1, 4)
    return items.withColumn("kind", F.when((F.col("kind") == "paragraph") & body & fits & F.forall(title, lambda w: ~F.rlike(w, F.lit(r"^\p{Ll}"))), "heading").otherwise(F.col("kind")))


def merge_front_matter(items: DataFrame) -> DataFrame:
    """Front-matter lines that go on from the one before join it."""
    w = Window.partitionBy("doc_id").orderBy("item_index")
    before = F.lag("text").over(w)
    on = (F.col("kind") == "front_matter") & (F.lag("kind").over(w) == "front_matter") & (F.endswith(before, F.lit("-")) | (F.rlike(F.lower(before), F.lit("^(index terms|keywords)")) & (F.rlike("text", F.lit(r"^\p{Ll}")) | (F.size(T.words(F.col("text"))) <= 20))))
    return _merged(items, F.coalesce(on, F.lit(False)))


def _merged(items: DataFrame, joins_before) -> DataFrame:
    """Runs of rows that join the one before become one row, with the texts in order."""
    w = Window.partitionBy("doc_id").orderBy("item_index")
    run = items.withColumn("__on", joins_before).withColumn("__run", F.sum((~F.col("__on")).cast("int")).over(w))
    columns = [c for c in items.columns if c not in ("doc_id", "item_index", "text")]
    held = F.sort_array(F.collect_list(F.struct("item_index", "text", *columns)))  # one buffer a run: most runs are one row
    out = run.groupBy("doc_id", "__run").agg(held.alias("__held")).withColumn("__first", F.get("__held", F.lit(0)))
    text = F.array_join(F.transform("__held", lambda s: s["text"]), " ")
    return out.select(*("doc_id" if c == "doc_id" else text.alias(c) if c == "text" else F.col(f"__first.{c}").alias(c) for c in items.columns))


def nearest_captions(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """The caption of each table row: before wins over after, the same section over others, then the nearest.

    The choice only ever falls on the last caption before, or the first after, in the section or the document, so
    running windows find the four and no pairs are formed.
    """
    cap = F.struct(F.col("caption_index").alias("at"), F.col("caption_id").alias("id"), F.col("caption_section").alias("section"))
    every = rows.select("document_id", "chunk_id", F.col("chunk_index").alias("at"), "section", F.lit(None).cast("struct<at:int,id:bigint,section:int>").alias("cap")).unionByName(
        captions.select("document_id", F.lit(None).cast("long").alias("chunk_id"), F.col("caption_index").alias("at"), F.col("caption_section").alias("section"), cap.alias("cap")))
    found = {}
    for name, keys in (("section", ("document_id", "section")), ("any", ("document_id",))):
        before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        after = Window.partitionBy(*keys).orderBy("at").rowsBetween(0, Window.unboundedFollowing)
        found[name] = F.last("cap", ignorenulls=True).over(before), F.first("cap", ignorenulls=True).over(after)
    best = F.coalesce(found["section"][0], found["any"][0], found["section"][1], found["any"][1])
    return every.withColumn("best", best).where("chunk_id IS NOT NULL AND best IS NOT NULL").select("document_id", "chunk_id", F.col("best.id").alias("caption_id"))


def carry_headers(rows: DataFrame) -> DataFrame:
    """Rows of a continued table without headers take the last ones of the table (doc_id, table_id, item_index, headers)."""
    w = Window.partitionBy("doc_id", "table_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("headers", F.last("headers", ignorenulls=True).over(w))


def items_to_blocks(items: DataFrame, titles: DataFrame, depth: int = 3) -> DataFrame:
    """All passes in order, then blocks with their heading path; front matter stays outside sections."""
    classified = classify_items(items).select("doc_id", "item_index", "kind", "text", "page_no")
    kept = merge_front_matter(promote_subsections(suppress_artifacts(suppress_title(classified, titles), titles)))
    level = F.when(F.col("kind") == "heading", F.least(F.lit(depth), T.heading_level(F.col("text"), F.lit(None).cast("int"))))
    stacked = heading_stack(merge_equations(kept.withColumn("level", level)), "doc_id", "item_index", "level", "text", depth)
    path = F.array_compact(F.array(*(F.col(f"level{n}") for n in range(1, depth + 1))))
    w = Window.partitionBy("doc_id").orderBy("item_index")
    return stacked.select("doc_id", (F.row_number().over(w) - 1).alias("order_index"), F.col("kind").alias("block_type"), F.col("text").alias("content"), "page_no", F.when(F.col("kind") == "front_matter", F.array()).otherwise(path).cast("array<string>").alias("section_path"))

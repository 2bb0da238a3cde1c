"""The structure graph of documents: chunk links, section nodes, siblings, ancestors. All joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def link_chunks(chunks: DataFrame) -> DataFrame:
    """previous_chunk_id and next_chunk_id in document order."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.withColumn("previous_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))


def sections(chunks: DataFrame) -> DataFrame:
    """Section nodes with their parent and the range of their blocks and pages."""
    return chunks.groupBy("node_id").agg(
        F.first("parent_node_id").alias("parent_node_id"), F.first("document_id").alias("document_id"), F.min("chunk_index").alias("block_order"), F.max("chunk_index").alias("block_order_end"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))


def siblings_of(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """seed and sibling: other nodes under the seed's parent. A node without a parent has none."""
    s = seeds.select(F.col("node_id").alias("seed"), "parent_node_id", F.col("block_order").alias("seed_order"))
    n = nodes.select(F.col("node_id").alias("sibling"), "parent_node_id", F.col("block_order").alias("sibling_order"))
    return s.join(n, "parent_node_id").where("seed <> sibling").dropDuplicates(["seed", "sibling"])


def nearest_siblings(nodes: DataFrame, most: int = 2) -> DataFrame:
    """The `most` nearest siblings of every node by block order.

    The nearest lie among the `most` nodes before and after in order, so lags and leads find them without a self-join.
    """
    order = Window.partitionBy("parent_node_id").orderBy("block_order", "node_id")
    near = [f(F.struct(F.col("node_id").alias("sibling"), F.col("block_order").alias("at")), i).over(order) for i in range(1, most + 1) for f in (F.lag, F.lead)]
    listed = nodes.select(F.col("node_id").alias("seed"), F.col("block_order"), F.array_compact(F.array(*near)).alias("near"))
    found = listed.select("seed", "block_order", F.explode("near").alias("n"))
    best = Window.partitionBy("seed").orderBy(F.abs(F.col("n.at") - F.col("block_order")), "n.at")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("seed", "n.sibling", "rank")


def sibling_edges(nodes: DataFrame) -> DataFrame:
    order = Window.partitionBy("parent_node_id").orderBy("block_order", "node_id")
    near = F.array(
        F.struct(F.lead("node_id").over(order).alias("to_id"), F.lit("next_sibling").alias("edge_type")), F.struct(F.lag("node_id").over(order).alias("to_id"), F.lit("previous_sibling").alias("edge_type")))
    return nodes.select("node_id", near.alias("near")).select("node_id", F.explode("near").alias("e")).select(F.col("node_id").alias("from_id"), "e.to_id", "e.edge_type").where("to_id IS NOT NULL")


def ancestors_of(seeds: DataFrame, edges: DataFrame, most_depth: int) -> DataFrame:
    """seed, ancestor and depth up to most_depth over edges (id, parent); the depth is small, so the recursion is unrolled."""
    level = seeds.select(F.col("id").alias("seed"), "id")
    out = None
    for depth in range(1, most_depth + 1):
        level = level.join(edges, "id").select("seed", F.col("parent").alias("id")).distinct()
        found = level.select("seed", F.col("id").alias("ancestor"), F.lit(depth).alias("depth"))
        out = found if out is None else out.unionByName(found)
    return out


def section_tree(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and nodes of parsed blocks (document_id, order_index, block_type, content, section_path).

    Chunks: every block but headings, as a child chunk (chunk_id `c:<document>:<order>`) with its node. Nodes: one for every
    prefix of a section path, with its parent, its first block, and the id of its parent chunk (`p:<node>`), null where no
    block stands directly under the node's heading. Blocks before the first heading have no node. Equal paths in a document
    are one node.
    """
    text = F.col("document_id").cast("string")
    key = lambda path: F.md5(F.concat_ws("\x1f", text, F.array_join(path, " > ")))
    path = F.col("section_path")
    body = blocks.where("block_type <> 'heading'")
    chunks = body.select(
        F.concat_ws(":", F.lit("c"), text, "order_index").alias("chunk_id"), "document_id", F.col("order_index").alias("chunk_index"), "content", F.col("block_type").alias("content_kind"),
        F.when(F.size(path) > 0, key(path)).alias("node_id"))
    each = blocks.where(F.size(path) > 0).select("document_id", "order_index", (F.col("block_type") != "heading").alias("body"), "section_path", F.explode(F.sequence(F.lit(1), F.size(path))).alias("level"))
    here = F.slice(path, F.lit(1), F.col("level"))
    nodes = each.withColumn("path", here).groupBy("document_id", "path").agg(F.min("order_index").alias("block_order"), F.max(F.col("body") & (F.size("section_path") == F.size("path"))).alias("has_body"))
    above = F.when(F.size("path") > 1, key(F.slice("path", F.lit(1), F.size("path") - 1)))
    named = nodes.select("document_id", key(F.col("path")).alias("node_id"), above.alias("parent_node_id"), "block_order", "has_body", F.array_join("path", " > ").alias("path"))
    return chunks, named.withColumn("parent_chunk_id", F.when(F.col("has_body"), F.concat(F.lit("p:"), "node_id"))).drop("has_body")


def section_relations(seeds: DataFrame, chunks: DataFrame, nodes: DataFrame, most_depth: int = 2) -> DataFrame:
    """chunk_id, relation, to_id and depth: what the section tree reaches from the chunks of seeds.

    The parent chunks of the own node, of its ancestors up to most_depth (their number is the depth, 1 for other relations) and
    of its two nearest siblings, the chunks before and after, and the other chunks of the node. Only the documents of the
    seeds are read. A chunk without a node has neighbours alone.
    """
    own = seeds.select("chunk_id").distinct()
    linked = link_chunks(chunks.select("chunk_id", "document_id", "chunk_index", "node_id")).join(own, "chunk_id", "left_semi")
    near = linked.select("chunk_id", F.lit("neighbor").alias("relation"), F.explode(F.array_compact(F.array("previous_chunk_id", "next_chunk_id"))).alias("to_id"), F.lit(1).alias("depth"))
    held = linked.where("node_id IS NOT NULL").select("chunk_id", "node_id")
    parents = nodes.where("parent_chunk_id IS NOT NULL").select(F.col("node_id").alias("at"), F.col("parent_chunk_id").alias("to_id"))
    to_parent = lambda rows, relation: rows.join(parents, "at").select("chunk_id", F.lit(relation).alias("relation"), "to_id", "depth")
    same = to_parent(held.select("chunk_id", F.col("node_id").alias("at"), F.lit(1).alias("depth")), "same_node_parent")
    inside = chunks.select("node_id", F.col("chunk_id").alias("to_id")).join(held, "node_id").where("chunk_id <> to_id").select("chunk_id", F.lit("same_node_child").alias("relation"), "to_id", F.lit(1).alias("depth"))
    edges = nodes.where("parent_node_id IS NOT NULL").select(F.col("node_id").alias("id"), F.col("parent_node_id").alias("parent"))
    above = ancestors_of(held.select(F.col("node_id").alias("id")).distinct(), edges, most_depth).select(F.col("seed").alias("node_id"), F.col("ancestor").alias("at"), "depth")
    beside = nearest_siblings(nodes.where("parent_node_id IS NOT NULL")).select(F.col("seed").alias("node_id"), F.col("sibling").alias("at"), F.lit(1).alias("depth"))
    return near.unionByName(same).unionByName(inside).unionByName(to_parent(held.join(above, "node_id"), "ancestor_parent")).unionByName(to_parent(held.join(beside, "node_id"), "sibling_parent"))

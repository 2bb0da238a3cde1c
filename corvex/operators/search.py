"""Retrieval for many questions at once: vector and lexical ranking, fusion, boosts, expansion, reranking, dedup, context.

Questions come in blocks of bounded size, each block broadcast against all rows; ranking frames carry ids and scores,
texts join at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvex.functions import text as T

QUERY_BLOCK = 2048
TILE, TILE_ROWS = 512, 2048  # scores are made for so many questions and rows at a time, which bounds a task's memory
#: How much of a seed's score each relation keeps.
DECAY = {"seed": 1.0, "same_node_parent": 0.97, "neighbor": 0.94, "same_node_child": 0.90, "ancestor_parent": 0.87, "sibling_parent": 0.84}
SLOT_TEXT = 40


def ranked(rows: DataFrame, key: str, score: str, tie: str, k: int, out: str = "rank") -> DataFrame:
    """The k best of each key by score, ties by the tie column."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return rows.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


class Best:
    """The k best (score, then smaller number) of each of n rows, flat and in order."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.least = np.full(n, -np.inf)  # the k-th score of a row that has k
        self.row, self.number, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def take(self, score: np.ndarray, number: np.ndarray, digits: int | None = None) -> None:
        """score: rows x candidates, number: the candidates'; what may be among the best is rounded to so many digits."""
        bar = self.least
        if score.shape[1] > self.k and np.isneginf(bar).any():  # no candidate under a tile's own k-th is among the best
            bar = np.fmax(bar, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1])  # nan last, and never the bar
        row, column = np.nonzero(score >= (bar if digits is None else bar - 10.0**-digits)[:, None])
        found = score[row, column]
        self.add(row, number[column], found if digits is None else np.round(found, digits))

    def add(self, row: np.ndarray, number: np.ndarray, score: np.ndarray) -> None:
        """Candidates of rows, flat; numbers are longs or strings."""
        good = score >= self.least[row]
        if not good.any():
            return
        if not len(self.number):
            self.number = self.number.astype(number.dtype)
        row, found, number = np.concatenate([self.row, row[good]]), np.concatenate([self.score, score[good]]), np.concatenate([self.number, number[good]])
        order = np.lexsort((number, -found, row))
        row, found, number = row[order], found[order], number[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.score, self.number = row[kept], found[kept], number[kept]
        full = place[kept] == self.k - 1
        self.least[self.row[full]] = self.score[full]


def nearest_rows(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id and score of the k nearest of all rows (vec_id, embedding) to each question (ids, unit vectors q)."""
    tops = [(ids[at : at + TILE], q[at : at + TILE], Best(min(TILE, len(ids) - at), k)) for at in range(0, len(ids), TILE)]
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(at, TILE_ROWS)
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            number = part.column(0).to_numpy()
            for _, asked, top in tops:
                top.take(asked @ v.T, number, 6)
    for own, _, top in tops:
        yield pa.RecordBatch.from_arrays([pa.array(own[top.row]), pa.array(top.number), pa.array(top.score)], ["query_id", "vec_id", "score"])


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 24, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest rows by cosine (6 decimals, ties by vec_id).

    queries: query_id and vector; they are cut into blocks of at most `block`, and each block passes over the rows once: a
    task keeps k rows a question, so what is shuffled is k rows a task and question. A task's memory depends on neither table's size.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        held = numbered.where(F.col("__block") == b).select("query_id", "vector").toPandas()
        if not len(held):
            continue
        q = np.stack(held["vector"].to_numpy()).astype(np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((held["query_id"].to_numpy(), q))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from nearest_rows(batches, *sent.value, k)

        part = vectors.select("vec_id", "embedding").mapInArrow(best, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return ranked(out, "query_id", "score", "vec_id", k)


def lsh_top_k(queries: DataFrame, vectors: DataFrame, k: int = 24, tables: int = 72, bits: int = 6, seed: int = 5) -> DataFrame:
    """Approximate vector_top_k: rows that share a random-hyperplane bucket with the question in any table, then exact cosine."""
    size = len(vectors.select("embedding").head()[0])
    planes = np.random.default_rng(seed).normal(size=(tables * bits, size))

    def buckets(rows: DataFrame, key: str, vector: str) -> DataFrame:
        @F.pandas_udf("array<long>")
        def hashed(v: pd.Series) -> pd.Series:
            side = (np.stack(v.to_numpy()).astype(np.float64) @ planes.T > 0).reshape(len(v), tables, bits)
            code = (side * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << bits)
            return pd.Series(list(code))

        return rows.select(key, F.explode(hashed(vector)).alias("bucket"))

    pairs = buckets(queries, "query_id", "vector").join(buckets(vectors, "vec_id", "embedding"), "bucket").select("query_id", "vec_id").distinct()
    unit = lambda v: F.transform(v, lambda x: x.cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = pairs.join(queries, "query_id").join(vectors, "vec_id").select("query_id", "vec_id", unit(F.col("vector")).alias("a"), unit(F.col("embedding")).alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return ranked(both.select("query_id", "vec_id", F.round(dot / (norm(F.col("a")) * norm(F.col("b"))), 6).alias("score")), "query_id", "score", "vec_id", k)


def postings(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """chunk_id, term and its positions: the inverted index of lower-cased words without signs."""
    word = F.lower(T.strip_signs(F.col("word")))
    each = chunks.select("chunk_id", F.posexplode(T.words(F.col(text_col))).alias("at", "word")).select("chunk_id", word.alias("term"), "at").where(F.char_length("term") > 2)
    return each.groupBy("chunk_id", "term").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def matches(questions: DataFrame, chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """query_id, chunk_id and lists, the positions of each term, for chunks that hold all terms of a question.

    A question meets the chunks of its rarest term alone (a merge join: the size of an exploded side is not known), and
    the other terms are looked up in the text of those chunks, so frequent terms do not multiply rows. Questions without
    terms match nothing.
    """
    words = F.transform(T.words(F.col(text_col)), lambda w: F.lower(T.strip_signs(w)))
    each = chunks.select("chunk_id", F.explode(F.array_distinct(words)).alias("term"))
    asked = questions.select("query_id", F.array_distinct("terms").alias("terms"))
    single = asked.select("query_id", "terms", F.explode("terms").alias("term"))
    held = each.select("term").join(single.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("held"))
    rarest = single.join(held, "term", "left").groupBy("query_id").agg(F.min_by(F.struct("term", "terms"), F.struct(F.coalesce("held", F.lit(0)), "term")).alias("least")).select("query_id", "least.*")
    at = lambda t: F.filter(F.transform("words", lambda w, i: F.when(w == t, i)), lambda i: i.isNotNull())
    near = each.join(rarest.hint("merge"), "term").select("query_id", "terms", "chunk_id")
    return near.join(chunks.select("chunk_id", words.alias("words")), "chunk_id").where(F.size(F.array_except("terms", "words")) == 0).select("query_id", "chunk_id", F.transform("terms", at).alias("lists"))


def lexical_top_k(found: DataFrame, k: int = 24) -> DataFrame:
    """query_id, chunk_id, score and rank of the matches, by summed term frequency."""
    score = F.aggregate("lists", F.lit(0.0), lambda s, x: s + F.size(x))
    return ranked(found.select("query_id", "chunk_id", score.alias("score")), "query_id", "score", "chunk_id", k)


def cover_density(found: DataFrame) -> DataFrame:
    """query_id, chunk_id and score of the matches: cover density rank (Clarke, Cormack and Tudhope), the sum of 1 / length over the shortest spans that hold all terms."""

    place = F.transform("lists", lambda ps, i: F.transform(ps, lambda p: F.struct(p.alias("p"), i.alias("i"))))
    start = F.struct(F.transform("lists", lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("low"), F.lit(0.0).alias("sum"))

    def step(state, event):
        last = F.transform(state["last"], lambda p, i: F.when(i == event["i"], event["p"]).otherwise(p))
        low = F.array_min(last)
        new = low > state["low"]  # all terms were met, and the span starts behind the one before
        return F.struct(last.alias("last"), F.greatest(low, state["low"]).alias("low"), (state["sum"] + F.when(new, 1.0 / (event["p"] - low + 1)).otherwise(0.0)).alias("sum"))

    density = F.aggregate(F.array_sort(F.flatten(place)), start, step, lambda state: state["sum"])
    return found.select("query_id", "chunk_id", F.round(density, 6).alias("score"))


def websearch_match(question: str):
    """A condition on the lower-cased term array `terms` for web-search syntax: words all, "or" either, -word not, quotes a phrase (`text`)."""
    import re

    parts = re.findall(r'-?"[^"]*"|\S+', question.lower())
    clauses: list = []
    either = False
    for p in parts:
        if p == "or":
            either = bool(clauses)
            continue
        no, body = p.startswith("-"), p.lstrip("-").strip('"').strip(T.SIGNS)
        if not body:
            continue
        c = F.contains(F.lower("content"), F.lit(body)) if " " in body else F.array_contains("terms", body)
        c = ~c if no else c
        if either:
            clauses[-1] = clauses[-1] | c
        else:
            clauses.append(c)
        either = False
    out = F.lit(bool(clauses))
    for c in clauses:
        out = out & c
    return out


def fuse(vector: DataFrame, lexical: DataFrame, weights: DataFrame | None = None, constant: int = 60, vector_weight: float = 1.0, fts_weight: float = 0.85) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, chunk_id, rank): only ranks count. Ties keep the vector order, then the lexical one."""
    both = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank")).join(lexical.select("query_id", "chunk_id", F.col("rank").alias("fts_rank")), ["query_id", "chunk_id"], "full_outer")
    if weights is not None:
        both = both.join(weights.select("query_id", "vector_weight", "fts_weight"), "query_id")
    else:
        both = both.withColumn("vector_weight", F.lit(vector_weight)).withColumn("fts_weight", F.lit(fts_weight))
    share = lambda w, r: F.coalesce(F.col(w) / (constant + F.col(r)), F.lit(0.0))
    scored = both.withColumn("fused", F.round(share("vector_weight", "vector_rank") + share("fts_weight", "fts_rank"), 8))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("fts_rank"), "chunk_id")
    return scored.select("query_id", "chunk_id", "vector_rank", "fts_rank", "fused", F.row_number().over(w).alias("rank"))


def structural_boost(question, f, terms, section, content, kind, labels=()):
    """What a candidate gains from section and content overlap, quoted phrases and kinds that the question (features f, terms) asks for.

    labels are the candidate's equation, caption and algorithm labels (null for none): each that the question names counts.
    """
    section_terms = T.terms(section)
    section_n, content_n = F.size(F.array_intersect(terms, section_terms)), F.size(F.array_intersect(terms, F.slice(T.ranked_terms(content), 1, SLOT_TEXT)))
    hinted = F.size(F.array_intersect(f["section_terms"], section_terms))
    add = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    total = (
        F.least(F.lit(0.12), section_n * 0.03) + F.least(F.lit(0.08), content_n * 0.01) + add((section != "") & F.contains(F.lower(question), F.lower(section)), 0.08) + F.least(F.lit(0.16), hinted * 0.05)
        + add(F.coalesce(F.contains(F.lower(content), f["quoted_phrase"]), F.lit(False)), 0.08)
        + F.when(f["has_table"] & (kind == "table_row"), 0.12).when(f["has_table"] & kind.isin("table", "table_caption"), 0.08).otherwise(0.0)
        + F.when(f["has_equation"] & (kind == "equation"), 0.12).when(f["has_equation"] & kind.isin("equation_explanation", "equation_group"), 0.08).otherwise(0.0)
        + add(f["has_algorithm"] & (kind == "algorithm"), 0.10) + add(f["has_figure"] & (kind == "figure_caption"), 0.08))
    for label in labels:
        total = total + add(F.coalesce((label != "") & F.contains(F.lower(question), F.lower(label)), F.lit(False)), 0.08)
    return F.when(F.size(terms) > 0, F.round(total, 6)).otherwise(F.lit(0.0))


def rerank_gain(terms, content):
    """A quarter of the share of the question's terms that the content holds."""
    return F.round(F.size(F.array_intersect(terms, T.terms(content))) * 0.25 / F.greatest(F.lit(1), F.size(terms)), 6)


def needs_rewrite(candidates: DataFrame, questions: DataFrame, low_score: float = 0.018, low_documents: int = 2) -> DataFrame:
    """query_id and rewrite: whether the question allows it (allow_rewrite), and its best score or its number of documents is low or it has no candidates."""
    low = candidates.groupBy("query_id").agg(((F.max("fused") < low_score) | (F.count_distinct("document_id") < low_documents)).alias("low"))
    return questions.select("query_id", "allow_rewrite").join(low, "query_id", "left").select("query_id", (F.col("allow_rewrite") & F.coalesce("low", F.lit(True))).alias("rewrite"))


def followed_relations(query_class, f, kind):
    """The relations that the class and the features f of a question let a seed of this content kind follow."""
    exact = query_class.isin("fact", "numeric_detail") | f["has_table"] | f["has_equation"]
    child = (query_class == "compare") | (exact & F.coalesce(kind.isin("table_row", "equation", "equation_explanation"), F.lit(False)))
    broad = query_class.isin("summary", "why", "conclusion", "compare")
    return F.array_compact(F.array(*map(F.lit, ("same_node_parent", "neighbor", "ancestor_parent")), F.when(child, F.lit("same_node_child")), F.when(broad, F.lit("sibling_parent"))))


def expand_graph(seeds: DataFrame, relations: DataFrame, most_seeds: int = 6) -> DataFrame:
    """Candidates after expansion: seeds (query_id, chunk_id, score, rank) and, for the best, what relations (chunk_id, relation, to_id) reach.

    A reached chunk has the seed's score times the relation's decay; of several ways the highest score and the first relation count.
    A seed with a column follows (array of relation names) follows these alone; with a column deepest, no relation of a greater depth.
    """
    decay = F.create_map(*(x for k, v in DECAY.items() for x in (F.lit(k), F.lit(v))))
    order = F.create_map(*(x for i, k in enumerate(DECAY) for x in (F.lit(k), F.lit(i))))
    start = seeds.select("query_id", "chunk_id", "score", F.lit("seed").alias("relation"), F.col("rank").alias("seed_rank"))
    best = seeds.where(F.col("rank") <= most_seeds).join(relations, "chunk_id")
    if "follows" in seeds.columns:
        best = best.where(F.array_contains("follows", F.col("relation")))
    if "deepest" in seeds.columns:
        best = best.where(F.col("depth") <= F.col("deepest"))
    reached = best.select("query_id", F.col("to_id").alias("chunk_id"), F.round(F.col("score") * decay[F.col("relation")], 8).alias("score"), "relation", F.col("rank").alias("seed_rank"))
    every = start.unionByName(reached)
    first = F.min_by("relation", F.struct((F.col("relation") != "seed").cast("int"), "seed_rank", order[F.col("relation")]))
    return every.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), first.alias("relation"))


#: What a chosen candidate is for, by the relation that reached it.
ROLES = {"seed": "primary_seed", "same_node_parent": "local_support", "same_node_child": "local_support", "neighbor": "local_support", "ancestor_parent": "ancestor_context", "sibling_parent": "sibling_context"}
BROAD = ("summary", "compare", "why", "conclusion")


def select_context(candidates: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Greedy near-duplicate removal and context assembly of each question, in rank order (a few dozen rows a question).

    candidates: query_id, rank, chunk_id, document_id, node_id, parent_id, section_key, structure_key, content_kind,
    structure_group, content, block, the strategy's columns top_k, per_document, budget, diversity, prefer_diversity,
    min_new_terms, query_class, and, all of which may be left out, parent_content, relation (how the graph reached it) and
    graph_enabled. Candidates of one parent are duplicates; where a parent's content is given, its terms are compared and
    counted in place of the candidate's. With the graph a node has a limit and sections are told apart by structure_key,
    without it by section_key. Returns every candidate with slot (from 1 for the chosen), role, or the reason it dropped.
    """
    columns = ["query_id", "chunk_id", "rank", "slot", "role", "reason", "total_tokens"]

    def terms(text: str) -> list[str]:
        counts: dict[str, int] = {}
        for w in text.split():
            w = w.strip(T.SIGNS).lower()
            if len(w) > 2:
                counts[w] = counts.get(w, 0) + 1
        return sorted(counts, key=lambda w: -counts[w])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        out, chosen, documents, sections, nodes, groups, seen = [], 0, {}, set(), {}, set(), set()
        total = 0
        for r in group.sort_values("rank").itertuples():
            every = terms(getattr(r, "parent_content", None) or r.content)
            own = set(every)
            graph, relation = bool(getattr(r, "graph_enabled", False)), getattr(r, "relation", None)
            section, node = (r.structure_key if graph else r.section_key), r.node_id if graph else None
            reason = role = None
            if any((r.parent_id == p and p is not None) or (own and t and len(own & t) / len(own | t) >= threshold) for p, t in kept):
                reason = "duplicate"
            else:
                kept.append((r.parent_id, own))
                cost, fresh = max(1, len(r.block) // 4), set(every[:50])
                if chosen >= r.top_k:
                    reason = "top_k"
                elif documents.get(r.document_id, 0) >= r.per_document:
                    reason = "per_document_limit"
                elif node is not None and nodes.get(node, 0) >= (3 if r.query_class == "compare" else 2):
                    reason = "duplicate_section"
                elif r.prefer_diversity and section in sections and len(sections) < r.diversity:
                    reason = "duplicate_section"
                elif r.query_class == "summary" and r.content_kind == "table_row" and (r.structure_group or "") in groups:
                    reason = "low_incremental_value"
                elif r.structure_group and r.structure_group in groups and r.content_kind in ("table_row", "equation") and r.query_class != "compare":
                    reason = "duplicate_section"
                elif r.min_new_terms > 0 and chosen and len(fresh - seen) < r.min_new_terms:
                    reason = "low_incremental_value"
                elif chosen and total + cost > r.budget:
                    reason = "token_budget"
                else:
                    wide = (r.section_key not in sections and len(sections) < r.diversity) or r.query_class in BROAD
                    role = ROLES.get(relation) or ("primary" if not chosen else "supporting" if wide else "supplemental")
                    chosen += 1
                    total += cost
                    documents[r.document_id] = documents.get(r.document_id, 0) + 1
                    if node is not None:
                        nodes[node] = nodes.get(node, 0) + 1
                    sections.add(section)
                    seen |= fresh
                    groups.add(r.structure_group or "")
            out.append((r.query_id, r.chunk_id, r.rank, chosen if role else None, role, reason, total))
        return pd.DataFrame(out, columns=columns).astype({"slot": "Int32"})

    return candidates.groupBy("query_id").applyInPandas(fold, "query_id long, chunk_id long, rank int, slot int, role string, reason string, total_tokens long")


def source_block(slot, title, path, page, kind, content):
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))
    return F.concat_ws("\n", F.concat(F.lit("[source:"), slot.cast("string"), F.lit("] Document: "), title), line("Section Path: ", path), line("Page: ", page.cast("string")), line("Content Kind: ", kind), F.lit(""), content)


def stage_trace(fused: DataFrame, context: DataFrame, chunks: DataFrame, length: int = 80) -> DataFrame:
    """query_id, stage, n and preview: how many candidates each retrieval stage leaves, and the start of its first one's text.

    fused: query_id, chunk_id, vector_rank, fts_rank, rank, as `fuse` gives it; context: as `select_context` gives it, over
    what was boosted, widened and reranked. Stages: vector, fts, merged, reranked, deduped, selected. A stage that leaves a
    question nothing has a row with 0 and no preview, if any stage has something for the question.
    """
    row = lambda stage, order, there: F.struct(F.lit(stage).alias("stage"), order.cast("int").alias("at"), there.alias("there"))
    f = fused.select("query_id", "chunk_id", F.explode(F.array(
        row("vector", F.col("vector_rank"), F.col("vector_rank").isNotNull()), row("fts", F.col("fts_rank"), F.col("fts_rank").isNotNull()), row("merged", F.col("rank"), F.lit(True)))).alias("x"))
    c = context.select("query_id", "chunk_id", F.explode(F.array(
        row("reranked", F.col("rank"), F.lit(True)), row("deduped", F.col("rank"), F.coalesce(F.col("reason") != "duplicate", F.lit(True))), row("selected", F.col("slot"), F.col("slot").isNotNull()))).alias("x"))
    every = f.unionByName(c)
    first = F.min_by("chunk_id", F.when(F.col("x.there"), F.col("x.at")))
    counts = every.groupBy("query_id", "x.stage").agg(F.count_if("x.there").alias("n"), F.when(F.count_if("x.there") > 0, first).alias("chunk_id"))
    stages = F.explode(F.array(*map(F.lit, ("vector", "fts", "merged", "reranked", "deduped", "selected"))))
    full = every.select("query_id").distinct().select("query_id", stages.alias("stage")).join(counts, ["query_id", "stage"], "left")
    shown = full.join(chunks.select("chunk_id", T.preview(F.col("content"), length).alias("preview")), "chunk_id", "left")
    return shown.select("query_id", "stage", F.coalesce("n", F.lit(0)).alias("n"), "preview")

"""Near-duplicate removal and context assembly against a plain model that looks at all chosen candidates anew for each rule."""

import random

from corvex.functions import text as T
from corvex.operators import search as S

SCHEMA = """query_id long, rank int, chunk_id long, document_id long, node_id long, parent_id long, section_key string, structure_key string, content_kind string, structure_group string, content string,
block string, top_k int, per_document int, budget int, diversity int, prefer_diversity boolean, min_new_terms int, query_class string, parent_content string, relation string, graph_enabled boolean"""


def terms(text):
    words = [w.strip(T.SIGNS).lower() for w in text.split()]
    words = [w for w in words if len(w) > 2]
    return sorted(dict.fromkeys(words), key=lambda w: (-words.count(w), words.index(w)))


def body(c):
    return c["parent_content"] or c["content"]


def alike(a, b):
    if a["parent_id"] is not None and a["parent_id"] == b["parent_id"]:
        return 1.0
    x, y = set(terms(body(a))), set(terms(body(b)))
    return len(x & y) / len(x | y) if x and y else 0.0


def plain_context(candidates):
    kept = []
    for c in sorted(candidates, key=lambda c: c["rank"]):
        if all(alike(c, k) < 0.92 for k in kept):
            kept.append(c)
    chosen = []
    for c in kept:
        if len(chosen) >= c["top_k"]:
            break
        key = "structure_key" if c["graph_enabled"] else "section_key"
        sections = {x[key] for x in chosen}
        group = c["structure_group"] or ""
        groups = [x["structure_group"] or "" for x in chosen]
        if sum(x["document_id"] == c["document_id"] for x in chosen) >= c["per_document"]:
            continue
        if c["graph_enabled"] and c["node_id"] is not None and sum(x["node_id"] == c["node_id"] for x in chosen) >= (3 if c["query_class"] == "compare" else 2):
            continue
        if c["prefer_diversity"] and c[key] in sections and len(sections) < c["diversity"]:
            continue
        if c["query_class"] == "summary" and c["content_kind"] == "table_row" and group in groups:
            continue
        if group and group in groups and c["content_kind"] in ("table_row", "equation") and c["query_class"] != "compare":
            continue
        known = {t for x in chosen for t in terms(body(x))[:50]}
        if c["min_new_terms"] > 0 and chosen and len(set(terms(body(c))[:50]) - known) < c["min_new_terms"]:
            continue
        cost = max(1, len(c["block"]) // 4)
        if chosen and sum(x["cost"] for x in chosen) + cost > c["budget"]:
            continue
        by_relation = {"seed": "primary_seed", "same_node_parent": "local_support", "same_node_child": "local_support", "neighbor": "local_support", "ancestor_parent": "ancestor_context", "sibling_parent": "sibling_context"}
        if c["relation"] in by_relation:
            role = by_relation[c["relation"]]
        elif not chosen:
            role = "primary"
        elif (c["section_key"] not in sections and len(sections) < c["diversity"]) or c["query_class"] in ("summary", "compare", "why", "conclusion"):
            role = "supporting"
        else:
            role = "supplemental"
        chosen.append({**c, "cost": cost, "role": role})
    return {c["chunk_id"] for c in candidates} - {c["chunk_id"] for c in kept}, [(c["chunk_id"], c["role"]) for c in chosen]


def test_context_equals_a_plain_model(spark):
    rng = random.Random(12)
    rows = []
    for q in range(300):
        graph, kind = rng.random() < 0.5, rng.choice(["summary", "compare", "why", "fact", "numeric_detail"])
        common = {"top_k": rng.randrange(1, 6), "per_document": rng.randrange(1, 4), "budget": rng.choice([20, 60, 500]), "diversity": rng.randrange(1, 3), "prefer_diversity": rng.random() < 0.5, "min_new_terms": rng.choice([0, 2, 3]), "query_class": kind, "graph_enabled": graph}
        for r in range(rng.randrange(1, 15)):
            text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta,", "(eta)", "to"]) for _ in range(rng.randrange(0, 9)))
            rows.append({"query_id": q, "rank": r + 1, "chunk_id": q * 100 + r, "document_id": rng.randrange(3), "node_id": rng.choice([None, 1, 2]), "parent_id": rng.choice([None, None, None, 1, 2]), "section_key": rng.choice("ab"), "structure_key": rng.choice("xyz"),
                         "content_kind": rng.choice(["table_row", "equation", "paragraph"]), "structure_group": rng.choice([None, "g1", "g2"]), "content": text, "block": "b" * rng.randrange(0, 120), **common, "parent_content": rng.choice([None, None, "alpha other parent words"]),
                         "relation": rng.choice([None, *S.DECAY]) if graph else None})
    got, dropped = {}, {}
    for r in S.select_context(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("query_id", "slot").collect():
        if r.slot:
            got.setdefault(r.query_id, []).append((r.chunk_id, r.role))
        elif r.reason == "duplicate":
            dropped.setdefault(r.query_id, set()).add(r.chunk_id)
    for q in range(300):
        duplicates, chosen = plain_context([r for r in rows if r["query_id"] == q])
        assert got.get(q, []) == chosen and dropped.get(q, set()) == duplicates, q


def test_stage_trace(spark):
    fused = spark.createDataFrame([(1, 10, 1, None, 2), (1, 11, 2, 1, 1), (2, 12, None, 1, 1)], "query_id long, chunk_id long, vector_rank int, fts_rank int, rank int")
    context = spark.createDataFrame([(1, 10, 2, None, "duplicate"), (1, 11, 3, 1, None), (1, 13, 1, None, "token_budget")], "query_id long, chunk_id long, rank int, slot int, reason string")
    chunks = spark.createDataFrame([(10, "ten"), (11, "  eleven  words"), (12, "twelve"), (13, "x" * 100)], "chunk_id long, content string")
    got = {(r.query_id, r.stage): (r.n, r.preview) for r in S.stage_trace(fused, context, chunks, 20).collect()}
    assert got == {
        (1, "vector"): (2, "ten"), (1, "fts"): (1, "eleven words"), (1, "merged"): (2, "eleven words"), (1, "reranked"): (3, "x" * 17 + "..."), (1, "deduped"): (2, "x" * 17 + "..."), (1, "selected"): (1, "eleven words"),
        (2, "vector"): (0, None), (2, "fts"): (1, "twelve"), (2, "merged"): (1, "twelve"), (2, "reranked"): (0, None), (2, "deduped"): (0, None), (2, "selected"): (0, None)}

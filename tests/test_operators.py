"""Operators that SQL does not express, against hand-computed values or a plain model."""

import datetime as dt
import io
import random
import wave
import zipfile
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from corvex.operators import access, search
from corvex.operators.chunking import split_recursive
from corvex.operators.graph import ancestors_of, nearest_siblings
from corvex.operators.state import partial_update, replace_by_key, upsert
from corvex.sources import formats
from corvex.sources.parsers import parse_docx, parse_html, parse_markdown
from corvex.streaming import limits
from tests.oracle import SF


def kinds(blocks):
    return [(b["block_type"], b["content"]) for b in blocks]


def test_html_blocks():
    page = b"""<html><head><title>t</title><script>x()</script></head><body><h1>Top</h1><p>One <b>two</b></p><div hidden>no</div>
    <h2>Sub</h2><ul><li>a<ul><li>b</li></ul></li></ul><table><caption>Table 1 Costs</caption><tr><th>k</th><th>v</th></tr><tr><td>x</td><td>1</td></tr></table>
    <p>$$a = b$$</p><p>where a denotes b</p><p>Figure 2 shows</p></body></html>"""
    got = parse_html(page)
    assert kinds(got) == [("heading", "Top"), ("paragraph", "One two"), ("heading", "Sub"), ("list_item", "a"), ("list_item", "b"), ("table_caption", "Table 1 Costs"),
                          ("table_row", "k: x | v: 1"), ("equation", "a = b"), ("equation_explanation", "where a denotes b"), ("figure_caption", "Figure 2 shows")]
    assert got[-1]["section_path"] == ["Top", "Sub"]
    assert got[4]["metadata"]["list_depth"] == "2"
    assert parse_html(b"") == []


def test_markdown_blocks():
    text = b"# A\n\nText one\nmore\n\n## B\n- x\n- y\n\n```\ncode\n```\n\nTable 1 Costs\n| k | v |\n|---|---|\n| x | 1 |\n\n$$e=1$$\n\nwhere e denotes one\n"
    got = parse_markdown(text)
    assert kinds(got) == [("heading", "A"), ("paragraph", "Text one more"), ("heading", "B"), ("list_item", "x"), ("list_item", "y"), ("paragraph", "code"), ("table_caption", "Table 1 Costs"),
                          ("table_row", "k: x | v: 1"), ("equation", "e=1"), ("equation_explanation", "where e denotes one")]
    assert got[3]["section_path"] == ["A", "B"]


def test_docx_blocks():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a &lt; b</w:t></w:r></w:p>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    assert kinds(parse_docx(raw.getvalue())) == [("heading", "Top"), ("paragraph", "a < b")]


def test_parse_documents(spark):
    raw = spark.createDataFrame([(1, "html", bytearray(b"<p>x</p>")), (2, "markdown", bytearray(b"# y")), (3, "text", None)], "document_id long, source_type string, content binary")
    assert sorted((r.document_id, r.block_type, r.content) for r in formats.parse_documents(raw).collect()) == [(1, "paragraph", "x"), (2, "heading", "y")]


def test_wav_duration(spark):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes(b"\0\0" * 1500)
    df = spark.createDataFrame([(bytearray(raw.getvalue()),), (bytearray(b"no"),), (None,)], "content binary")
    assert [r.duration_ms for r in formats.wav_duration_ms(df).collect()] == [1500, None, None]


def test_sources_and_sinks(spark, tmp_path):
    assert formats.read_golden(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "g.json").write_text('[{"question": "q", "required_document_ids": ["a"]}]')
    assert formats.read_golden(spark, str(tmp_path / "g.json")).first().required_document_ids == ["a"]
    (tmp_path / "r.json").write_text('{"questions": [{"question_id": "1", "retrieval": {"top1_hit": true}}]}')
    assert formats.read_run(spark, str(tmp_path / "r.json")).first().retrieval.top1_hit
    rows = spark.createDataFrame([(1, ["a", "b"])], "id int, xs array<string>")
    formats.write_scores(rows, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first().xs == "a | b"
    formats.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().xs == ["a", "b"]
    formats.write_processed_text(spark.createDataFrame([("w", 1, "hello")], "workspace_id string, document_id int, text string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "hello"
    assert formats.read_blobs(spark, str(tmp_path / "g.json")).first().length > 0


def test_filters():
    assert access.sanitize_filters({"a": None, "b": [1, None], "c": {"d": []}, "e": "x"}) == {"b": [1], "e": "x"}
    assert access.split_filters({"document_ids": [1], "k": "v"}) == ({"k": "v"}, [1])


def test_split_recursive():
    assert split_recursive("aa bb cc", 5, 0) == ["aa bb", "cc"]
    assert split_recursive("a\n\nb", 900, 0) == ["a\n\nb"]
    assert all(len(p) <= 10 for p in split_recursive("x" * 35, 10, 2))
    assert "".join(split_recursive("x" * 35, 10, 0)) == "x" * 35


def test_graph(spark):
    nodes = spark.createDataFrame([(i, 1, 1, i * 2, i * 2) for i in range(5)], "node_id long, parent_node_id long, document_id long, block_order int, block_order_end int")
    assert sorted(r.sibling for r in nearest_siblings(nodes).where("seed = 2").collect()) == [1, 3]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "id long, parent long")
    assert sorted((r.ancestor, r.depth) for r in ancestors_of(spark.createDataFrame([(1,)], "id long"), edges, 2).collect()) == [(2, 1), (3, 2)]


def test_state(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(upsert(old, new, ["k"])) == {(1, "a"), (2, "c"), (3, None)}
    assert as_set(partial_update(old, new, ["k"])) == {(1, "a"), (2, "c")}
    assert as_set(replace_by_key(old, new, ["k"])) == {(1, "a"), (2, "c"), (3, None)}


def test_vector_recall(spark):
    """The exact search equals brute force, and the hashed one finds at least 0.9 of it."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = e.orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    exact = {(r.query_id, r.vec_id) for r in search.vector_top_k(q, e, 10, block=7).collect()}
    want = set()
    for i, r in enumerate(rows):
        if r.vec_id % 20 == 0:
            score = np.round(v @ v[i], 6)
            want |= {(r.vec_id, rows[j].vec_id) for j in np.lexsort((np.arange(len(rows)), -score))[:10]}
    assert exact == want
    near = {(r.query_id, r.vec_id) for r in search.lsh_top_k(q, e, 10).collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_matches_and_cover_density(spark):
    chunks = spark.createDataFrame([(1, "Aaa bbb x x x aaa."), (2, "aaa x"), (3, None), (4, "")], "chunk_id long, content string")
    asked = spark.createDataFrame([(7, ["aaa", "bbb"]), (8, ["aaa", "none"]), (9, [])], "query_id long, terms array<string>")
    found = search.matches(asked, chunks)
    assert [(r.query_id, r.chunk_id, r.lists) for r in found.collect()] == [(7, 1, [[0, 5], [1]])]
    assert [(r.chunk_id, r.score) for r in search.cover_density(found).collect()] == [(1, round(1 / 2 + 1 / 5, 6))]
    assert [(r.chunk_id, r.score, r.rank) for r in search.lexical_top_k(found).collect()] == [(1, 3.0, 1)]


def test_html_tables_short_rows_and_nested():
    from corvex.sources.parsers import parse_html

    got = parse_html(b"<table><tr><th>A</th><th>B</th><th>C</th></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>x</td><td>y</td></tr></table>")
    assert [b["text"] if "text" in b else b["content"] for b in got] == ["A: 1 | B: 2 | C: 3", "A: x | B: x | C: y"]
    got = parse_html(b"<table><tr><td>p</td><td>q</td></tr><tr><td>out <table><tr><td>h</td></tr><tr><td>in</td></tr></table>er</td><td>r</td></tr></table>")
    assert [b["text"] if "text" in b else b["content"] for b in got] == ["h: in", "p: out er | q: r"]
    got = parse_html(b"<table><tr><th>A</th><th>B</th></tr><tr><td>one<p>two</p></td><td><p>three</p></td></tr></table><p>after</p>")
    assert [b["text"] if "text" in b else b["content"] for b in got] == ["A: one two | B: three", "after"]


def test_context_rules(spark):
    base = dict(query_id=1, document_id=1, node_id=1, parent_id=None, section_key="s", content_kind="paragraph", structure_group=None, query_class="fact", top_k=2, per_document=1, budget=100, diversity=1, prefer_diversity=False, min_new_terms=0)
    rows = [base | dict(chunk_id=1, rank=1, content="alpha beta gamma", block="x" * 40), base | dict(chunk_id=2, rank=2, content="delta epsilon zeta", block="x"),
            base | dict(chunk_id=3, rank=3, document_id=2, content="alpha beta gamma", block="x"), base | dict(chunk_id=4, rank=4, document_id=3, content="eta theta iota", block="x" * 800), base | dict(chunk_id=5, rank=5, document_id=4, content="kappa lambda", block="x")]
    schema = "query_id long, document_id long, node_id long, parent_id long, section_key string, content_kind string, structure_group string, query_class string, top_k int, per_document int, budget int, diversity int, prefer_diversity boolean, min_new_terms int, chunk_id long, rank int, content string, block string"
    got = {r.chunk_id: (r.slot, r.reason) for r in search.select_context(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)).collect()}
    assert got == {1: (1, None), 2: (None, "per_document_limit"), 3: (None, "duplicate"), 4: (None, "token_budget"), 5: (2, None)}


    rows = [base | dict(chunk_id=i, rank=i, node_id=i, document_id=i, parent_id=parent, content=f"word{i} here", parent_content=text, block="x") for i, parent, text in ((1, 7, "alpha beta"), (2, 7, "gamma delta"), (3, 8, "alpha beta"), (4, None, None), (5, None, None))]
    schema = schema.replace("content string, block", "content string, parent_content string, block")
    got = {r.chunk_id: (r.slot, r.reason) for r in search.select_context(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)).collect()}
    assert got == {1: (1, None), 2: (None, "duplicate"), 3: (None, "duplicate"), 4: (2, None), 5: (None, "top_k")}


def test_rewrite_needs_leave_and_low_candidates(spark):
    found = spark.createDataFrame([(1, 0.9, 1), (1, 0.8, 2), (2, 0.9, 1), (3, 0.01, 1), (3, 0.01, 2), (4, 0.01, 1)], "query_id long, fused double, document_id long")
    asked = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True), (6, False)], "query_id long, allow_rewrite boolean")
    assert {r.query_id: r.rewrite for r in search.needs_rewrite(found, asked).collect()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_expansion_follows_what_the_class_allows(spark):
    rows = [("fact", "paragraph", False), ("fact", "table_row", False), ("summary", "equation", False), ("summary", "equation", True), ("compare", "paragraph", False), ("fact", None, False)]
    df = spark.createDataFrame([(i, c, k, t) for i, (c, k, t) in enumerate(rows)], "i int, c string, k string, t boolean").select("i", F.col("c"), F.col("k"), F.struct(F.col("t").alias("has_table"), F.lit(False).alias("has_equation")).alias("f"))
    got = {r.i: "".join(x for n, x in (("same_node_child", "c"), ("sibling_parent", "s")) if n in r.w) for r in df.select("i", search.followed_relations(F.col("c"), F.col("f"), F.col("k")).alias("w")).collect()}
    assert got == {0: "", 1: "c", 2: "s", 3: "cs", 4: "cs", 5: ""}
    seeds = spark.createDataFrame([(1, 10, 1.0, 1, ["neighbor"])], "query_id long, chunk_id long, score double, rank int, follows array<string>")
    reach = spark.createDataFrame([(10, "neighbor", 11), (10, "sibling_parent", 12)], "chunk_id long, relation string, to_id long")
    assert {(r.chunk_id, r.score) for r in search.expand_graph(seeds, reach).collect()} == {(10, 1.0), (11, 0.94)}


def test_boost_for_labels_that_the_question_names(spark):
    df = spark.createDataFrame([(1, "what does table iv show", "Table IV"), (2, "what does it show", "Table IV"), (3, "what does it show", None)], "i int, q string, label string")
    from corvex.functions import features, text

    ready = features.with_strategy(df, "q").withColumn("terms", text.terms(F.col("q")))
    boost = lambda labels: search.structural_boost(F.col("q"), F.col("f"), F.col("terms"), F.lit(""), F.lit("nothing"), F.lit("paragraph"), labels)
    got = {r.i: round(r.d, 6) for r in ready.select("i", (boost([F.col("label")]) - boost([])).alias("d")).collect()}
    assert got == {1: 0.08, 2: 0.0, 3: 0.0}


def test_rate_limit_batch_and_stream(spark, tmp_path):
    random.seed(1)
    start = dt.datetime(2024, 1, 1)
    rows = sorted((i, f"k{random.randint(0, 2)}", "default", start + dt.timedelta(seconds=random.randint(0, 300))) for i in range(300))
    df = spark.createDataFrame(rows, "request_id long, key string, profile string, ts timestamp")
    got = {r.request_id: r.allowed for r in limits.rate_limit(df, 20).collect()}
    logs, want = {}, {}
    for i, k, _, t in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        want[i] = limits.decide(logs.setdefault(k, deque()), t.timestamp(), 20)[0]
    assert got == want and not all(got.values())
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 20)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.request_id: r.allowed for r in spark.table("limited").collect()} == want


def test_idempotency(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, "k", "h", "in_progress", at(0)), (2, "k", "h", "completed", at(10)), (3, "k", "h", "completed", at(1000)), (4, "k", "h", "completed", at(1001)), (5, "k", "other", "completed", at(1002)), (6, "k", "other", "completed", at(100000))]
    got = {r.request_id: r.result for r in limits.idempotency(spark.createDataFrame(rows, "request_id long, key string, request_hash string, outcome string, ts timestamp")).collect()}
    assert got == {1: "new", 2: "conflict", 3: "reclaimed", 4: "replay", 5: "conflict", 6: "reclaimed"}


def test_webs_syntax(spark):
    df = spark.createDataFrame([(1, "red fox", ["red", "fox"]), (2, "red dog", ["red", "dog"]), (3, "blue fox", ["blue", "fox"])], "i int, content string, terms array<string>")
    ids = lambda q: sorted(r.i for r in df.where(search.websearch_match(q)).collect())
    assert ids("red -dog") == [1] and ids("dog or blue") == [2, 3] and ids('"blue fox"') == [3] and ids("") == []


def test_connector(spark, tmp_path):
    from corvex.sources.connector import ChangeLog

    spark.dataSource.register(ChangeLog)
    log = tmp_path / "changes.jsonl"
    log.write_text('{"source_id": "a", "kind": "put", "payload": 1}\n{"source_id": "b", "kind": "delete"}\n')
    assert [(r.offset, r.source_id) for r in spark.read.format("corvex_changes").load(str(log)).collect()] == [(0, "a"), (1, "b")]


def test_payload(spark):
    from corvex.functions import payload

    assert payload.table_of('{"headers": ["1", "2"], "rows": [["a", null]]}') == ([], [["a", ""]])
    assert payload.table_of('[{"x": 1}, {"y": 2}]') == (["x", "y"], [["1", ""], ["", "2"]])
    assert payload.table_of('[["h"], [{"text": " v "}]]') == (["h"], [["v"]])
    assert payload.table_of("no") == ([], [])
    df = spark.createDataFrame([('{"b": 1, "a": [2]}',), ('{"a":[2],"b":1}',), ("x",), (None,)], "t string")
    got = [r.h for r in df.select(payload.nested_request_hash("t").alias("h")).collect()]
    assert got[0] == got[1] and got[2] is None and got[3] is None
    v = [r.v for r in df.select(payload.hash_embedder(8)("t").alias("v")).collect()]
    assert len(v[0]) == 8 and abs(sum(x * x for x in v[0]) - 1) < 1e-5 and v[3] == [0.0] * 8


def test_item_passes(spark):
    from corvex.operators import pdf_items

    rows = [(1, 0, "text", "My Paper", 1), (1, 1, "author", "Jane Roe", 1), (1, 2, "section_header", "1. Introduction", 1), (1, 3, "text", "Some long plain words follow here in a row of text", 1), (1, 4, "text", "1.1 Data And Methods", 1),
            (1, 5, "formula", "x = y + (", 2), (1, 6, "text", "z )", 2), (1, 7, "page_footer", "7", 2), (1, 8, "section_header", "REFERENCES", 3), (1, 9, "text", "[1] A book", 3)]
    items = spark.createDataFrame(rows, "doc_id long, item_index int, label string, text string, page_no int")
    got = pdf_items.items_to_blocks(items, spark.createDataFrame([(1, "My Paper")], "doc_id long, title string")).orderBy("order_index").collect()
    assert [(r.block_type, r.content, r.section_path) for r in got] == [
        ("front_matter", "My Paper", []), ("front_matter", "Jane Roe", []), ("heading", "1. Introduction", ["1. Introduction"]), ("paragraph", "Some long plain words follow here in a row of text", ["1. Introduction"]),
        ("heading", "1.1 Data And Methods", ["1. Introduction", "1.1 Data And Methods"]), ("equation", "x = y + (z)", ["1. Introduction", "1.1 Data And Methods"]),
        ("heading", "REFERENCES", ["REFERENCES"]), ("reference", "[1] A book", ["REFERENCES"])]


def test_ranked_terms(spark):
    from corvex.functions.text import ranked_terms

    df = spark.createDataFrame([("beta, alpha beta! of (alpha) gamma alpha",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(ranked_terms("t").alias("x")).collect()] == [["alpha", "beta", "gamma"], [], []]

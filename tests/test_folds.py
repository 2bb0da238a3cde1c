"""Folds over layout items and provider fallback: cases with known results, and plain models on random input."""

import random

import pytest
from pyspark.sql import functions as F

from corvex.functions import text as T
from corvex.operators import fallback, item_folds


def equations(*items):
    rows = [{"doc_id": 1, "item_index": i, "kind": k, "text": t, "page_no": p} for i, (k, t, p) in enumerate(items)]
    return [(r["text"], r["merged"], r["orphan"]) for r in item_folds.fold_equations(rows) if r["kind"] == "equation"]


OPEN = "MSE = (1/N) Σ (y_i - ŷ_i"


@pytest.mark.parametrize("items, want", [
    ([("heading", "1. Intro", 1), ("equation", OPEN, 1), ("equation", ") 2", 1)], [(OPEN + ") 2", 1, False)]),
    ([("heading", "1. Intro", 1), ("equation", OPEN, 1), ("table_caption", "Table 1", 1), ("equation", ") 2", 1)], [(OPEN, 0, False), (") 2", 0, True)]),
    ([("equation", OPEN, 1), ("equation", "L Ridge = MSE + λ ||w||²", 1), ("equation", ") 2", 1)], [(OPEN, 0, False), ("L Ridge = MSE + λ ||w||²", 0, False), (") 2", 0, True)]),
    ([("equation", "a = (b +", 1), ("paragraph", "(c -", 1), ("equation", "d))", 2)], [("a = (b + (c - d))", 2, False)]),  # three in a row, judged on all taken in
    ([("equation", "a = (b +", 1), ("paragraph", "(c)", 3)], [("a = (b +", 0, True)]),  # not two pages on
    ([("equation", "value of a = (b", 1), ("heading", "2. Next", 1), ("equation", "(c)", 1)], [("value of a = (b", 0, False), ("(c)", 0, True)]),
    ([("equation", "total = sum(x", 1), ("equation", "y = w + v * u", 1)], [("total = sum(x y = w + v * u", 1, False)]),
    ([("equation", "complete = a + b + c", 1), ("equation", ") 2", 1)], [("complete = a + b + c", 0, False), (") 2", 0, True)]),
    ([], []),
])
def test_equation_cases(items, want):
    assert equations(*items) == want


def test_orphans_look_back_six_items():
    far = lambda n: [("heading", "h", 1), ("equation", "long name = (x", 1), *[("paragraph", "x" * 80 + " = + - () " + "y" * 20, 1)] * n, ("equation", ")^2", 1)]
    assert not item_folds.is_fragment("x" * 80 + " = + - () " + "y" * 20)
    assert [o for *_, o in equations(*far(1))] == [False, True]
    short = lambda n: [("equation", "long name = (x", 1), ("paragraph", "a paragraph of words", 1), *[("paragraph", "+ -", 1)] * n, ("equation", ")^2", 1)]
    assert [o for *_, o in equations(*short(2))] == [False, True]


def test_predicates_equal_the_column_forms(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab12 =+-*/^()[]{}<>ŷΣ|.") for _ in range(rng.randrange(0, 30))) for _ in range(2000)] + ["where x = y", ") 2", "^ 2", "^2", "a ^", "x" * 130 + "=="]
    rows = spark.createDataFrame([(item_folds.clean(t),) for t in texts], "t string").select("t", T.looks_like_equation_fragment(F.col("t")).alias("f"), T.looks_like_closing_tail(F.col("t")).alias("c"), T.equation_incomplete(F.col("t")).alias("i")).collect()
    for r in rows:
        assert (item_folds.is_fragment(r.t), item_folds.is_tail(r.t), item_folds.is_incomplete(r.t)) == (r.f, r.c, r.i), r.t


def plain_caption(rows, n, contexts):
    """The caption of row n by trying all captions in the stated order."""
    captions = [i for i, r in enumerate(rows) if r["kind"] == "table_caption"]
    ids = {i: rows[i]["table_id"] or f"{rows[i]['doc_id']}:{rows[i]['item_index']}" for i in captions}
    r = rows[n]
    named = [i for i in captions if r["table_id"] and ids[i] == r["table_id"]]
    low = lambda v: " ".join((v or "").lower().split())
    label = low(r["caption_label"])
    sets = [named[-1:], [i for i in captions if label and label != "table" and low(rows[i]["caption_label"]) == label], [i for i in captions if rows[i]["page_no"] == r["page_no"]], captions]
    rank = lambda i: 0 if contexts[i] == contexts[n] else 1 if contexts[i] and contexts[n] and contexts[i][-1] == contexts[n][-1] else 2
    for some in sets:
        if some is named[-1:] or some:
            if some:
                return ids[min(some, key=lambda i: (i > n, rank(i), abs(i - n)))]
    return None


def test_table_groups_equal_a_plain_model(spark):
    rng = random.Random(3)
    docs, want = [], {}
    for d in range(60):
        rows = []
        for i in range(rng.randrange(0, 40)):
            kind = rng.choice(["heading", "table_caption", "table_row", "table_row", "paragraph"] if d % 5 else ["heading", "table_row", "paragraph"])
            rows.append({"doc_id": d, "item_index": i, "kind": kind, "text": rng.choice(["A", "B", "C"]), "page_no": rng.choice([None, 1, 2, 3]), "level": rng.choice([None, 1, 2, 3]), "table_id": rng.choice([None, None, f"t{i}", f"t{i - 1}"]) if kind != "table_caption" else rng.choice([None, f"t{i}"]), "caption_label": rng.choice([None, "Table", "Table 1", " TABLE  1 ", "Table 2"])})
        docs += rows
        contexts, open_ = [], []
        for r in rows:
            if r["kind"] == "heading":
                level = r["level"] or 1
                while open_ and open_[-1][0] >= level:
                    open_.pop()
                open_.append((level, r["text"]))
            contexts.append(tuple(t for _, t in open_))
        for n, r in enumerate(rows):
            if r["kind"] == "table_row":
                want[d, n] = plain_caption(rows, n, contexts)
    df = spark.createDataFrame(docs, "doc_id long, item_index long, kind string, text string, page_no int, level int, table_id string, caption_label string, status string").repartition(3)
    got = item_folds.group_tables(df).collect()
    assert {(r.doc_id, r.item_index): r.table_id if r.status == "row_backed" else None for r in got if r.kind == "table_row"} == want
    used = {(d, t) for (d, _), t in want.items()}
    for r in got:
        if r.kind == "table_caption":
            assert r.status == ("row_backed" if (r.doc_id, r.table_id) in used else "caption_only") and (r.warning is None) == (r.status == "row_backed")
        elif r.kind == "table_row":
            assert (r.status == "unassigned_row") == (want[r.doc_id, r.item_index] is None) == (r.warning is not None)
    warned = {r.doc_id: r.warnings for r in item_folds.table_warnings(item_folds.group_tables(df)).collect()}
    assert all(len(w) == len(set(w)) for w in warned.values()) and set(warned) == {r.doc_id for r in got if r.warning}


def plain_route(chain, outcome):
    """chain: (provider, registered, max_retries); outcome(position, attempt) -> (error, retryable)."""
    log, retries = [], 0
    for p, (provider, registered, most) in enumerate(chain):
        if not registered:
            continue
        attempt = 0
        while True:
            error, retryable = outcome(p, attempt)
            retryable = error is not None and (retryable or error == "transport")
            log.append((len(log) + 1, provider, "failed" if error else "succeeded", error, retryable))
            if error is None:
                return ("succeeded", provider, len(log), retries, p > 0), log
            if retryable and attempt < most:
                attempt, retries = attempt + 1, retries + 1
                continue
            if error == "auth" and p == len(chain) - 1:
                return ("auth", None, len(log), retries, False), log
            break
    return ("unavailable", None, len(log), retries, False), log


def test_fallback_equals_a_plain_model(spark):
    rng = random.Random(4)
    chains = {f"p{i}": [(f"v{rng.randrange(4)}", rng.random() < 0.8, rng.randrange(3)) for _ in range(rng.randrange(1, 4))] for i in range(8)}
    calls = [(c, rng.choice([*chains, "none"])) for c in range(400)]
    script = {(c, p, a): rng.choice([(None, False), ("auth", False), ("rate_limit", True), ("transient", True), ("bad_request", False), ("auth", True)]) for c in range(400) for p in range(3) for a in range(3) if rng.random() < 0.8}
    results, log = fallback.route_calls(
        spark.createDataFrame(calls + calls[:9], "call_id long, profile string"),
        spark.createDataFrame([(p, i, *t) for p, ts in chains.items() for i, t in enumerate(ts)], "profile string, position int, provider string, registered boolean, max_retries int"),
        spark.createDataFrame([(*k, *v) for k, v in script.items()], "call_id long, position int, attempt int, error string, retryable boolean"))
    got, logged = {r.call_id: tuple(r)[1:] for r in results.collect()}, {}
    for r in log.orderBy("call_id", "number").collect():
        logged.setdefault(r.call_id, []).append(tuple(r)[1:])
    for c, profile in calls:
        want, attempts = plain_route(chains.get(profile, []), lambda p, a, c=c: script.get((c, p, a), ("transport", True)))
        assert got[c] == want and logged.get(c, []) == attempts, (c, chains.get(profile))


def test_fallback_retries_then_falls_back(spark):
    results, _ = fallback.route_calls(
        spark.createDataFrame([(1, "balanced"), (2, "single")], "call_id long, profile string"),
        spark.createDataFrame([("balanced", 0, "first", True, 1), ("balanced", 1, "second", True, 0), ("single", 0, "first", True, 1)], "profile string, position int, provider string, registered boolean, max_retries int"),
        spark.createDataFrame([(1, 0, 0, "transient", True), (1, 0, 1, "transient", True), (1, 1, 0, None, False), (2, 0, 0, "auth", False)], "call_id long, position int, attempt int, error string, retryable boolean"))
    assert {tuple(r) for r in results.collect()} == {(1, "succeeded", "second", 3, 1, True), (2, "auth", None, 1, 0, False)}


def test_folds_of_empty_tables(spark):
    items = spark.createDataFrame([], "doc_id long, item_index long, kind string, text string, page_no int, level int, table_id string, caption_label string")
    assert item_folds.merge_equations(items).count() == item_folds.group_tables(items).count() == item_folds.table_warnings(item_folds.group_tables(items)).count() == 0


def test_folds_cross_arrow_batches(spark):
    """Documents longer and shorter than a batch give what the fold gives for each of them; other kinds stay away when asked."""
    rng = random.Random(5)
    docs, want = [], set()
    for d in [None, *range(12)]:
        rows = [{"doc_id": d, "item_index": i, "kind": rng.choice(["heading", "equation", "equation", "paragraph"]), "text": rng.choice([OPEN, ") 2", "(c -", "+ b", "x = y + (", "words of a paragraph"]), "page_no": i // 9} for i in range(rng.choice([1, 2, 7, 40]))]
        docs += rows
        want |= {(d, r["item_index"], r["text"], r["merged"], r["orphan"]) for r in item_folds.fold_equations(rows) if r["kind"] == "equation"}
    df = spark.createDataFrame(docs, "doc_id long, item_index long, kind string, text string, page_no int").repartition(5, "item_index")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [(r.doc_id, r.item_index, r.text, r.merged, r.orphan) for r in item_folds.merge_equations(df, ("equation",)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == want and len(got) == len(want)


def test_white_space_is_what_the_class_says(spark):
    space = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x3100)]) if c.isspace()]
    texts = ["", " ", "  ", " a", "a ", "a b", "a  b", *(f"{p}{c}{q}{c}z{c}" for c in [*space, "​", "﻿", "~", "!"] for p in ("", "a", "a ", " ") for q in ("", "b", " b", "\t"))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_whitespace(F.col("t")).alias("clean"), T.words(F.col("t")).alias("words"), T.is_blank(F.col("t")).alias("blank")).collect()
    for r in got:
        assert (r.clean, r.words, r.blank) == (" ".join(r.t.split()), r.t.split(), not r.t.split()), ascii(r.t)


def test_items_are_normalized_once(spark):
    """Every use of a text after the first finds it clean: a second pass over its white space would be one for each use."""
    from corvex.operators import pdf_items

    items = spark.range(3).selectExpr("id AS doc_id", "id AS item_index", "'text' AS label", "concat('a  b ', id) AS text", "1 AS page_no")
    plan = pdf_items.classify_items(items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(") <= 1

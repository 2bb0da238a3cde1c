"""Cases that a review found: each failed before the change that its docstring names."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from corvex.catalog import QUERIES
from corvex.functions import lexemes
from corvex.functions import text as T
from corvex.operators import lexical, search
from corvex.plans import retrieval
from tests.oracle import SF


def test_positional_values_keep_their_digits(spark):
    """An element's place was trimmed from its ends: the eighth of these lost its sevens."""
    row = spark.range(1).select(T.positional_values(F.lit("0: a |1: b| 1: c | 1: d|1: e|1: f|1: g| 1: 555-8977")).alias("v")).head()
    assert row.v == ["a", "b", "c", "d", "e", "f", "g", "555-8977"]


def test_vector_literal_rounds_the_exact_value(spark):
    """Eight decimals of 53/512 are a tie, which goes to the even digit."""
    rows = spark.createDataFrame([([53 / 512, -1.0, None, 1e-9],), ([],), (None,)], "v array<float>").select(T.vector_literal("v").alias("x")).collect()
    assert [r.x for r in rows] == ["[0.10351562,-1.00000000,0.00000000]", "[]", None]


def test_best_of_tiles_equals_brute_force():
    """Scores come in tiles of bounded size, with ties across tiles."""
    rng = np.random.default_rng(2)
    score, number = np.round(rng.random((7, 900)), 1), rng.permutation(900)
    top = search.Best(7, 24)
    for at in range(0, 900, 50):
        top.take(score[:, at : at + 50], number[at : at + 50])
    want = [(r, *x) for r in range(7) for x in sorted(zip(-score[r], number))[:24]]
    assert list(zip(top.row, -top.score, top.number)) == want


def test_scores_that_cannot_win_are_neither_rounded_nor_kept():
    """Rounded ties count, scores that are no number do not; a tile hands on little more than its own best."""
    rng = np.random.default_rng(3)
    score, number = rng.random((7, 900)), rng.permutation(900)
    score[:, 5:800:9] = np.nan
    top, handed = search.Best(7, 24), []
    add = top.add
    top.add = lambda row, number, found: (handed.append(len(row)), add(row, number, found))
    for at in range(0, 900, 90):
        top.take(score[:, at : at + 90], number[at : at + 90], 2)
    good = np.flatnonzero(~np.isnan(score[0]))
    want = [(r, *x) for r in range(7) for x in sorted(zip(-np.round(score[r, good], 2), number[good]))[:24]]
    assert list(zip(top.row, -top.score, top.number)) == want and handed[0] < 7 * 40


@pytest.mark.parametrize("copies", [False, True])
def test_memory_of_vector_search_does_not_follow_the_table(copies):
    """A whole block of questions against batches as Spark hands them on: all scores of one batch at once are 164 MB."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    q = unit(rng.normal(size=(search.QUERY_BLOCK, 16)))

    def batches(n):
        for i in range(n):
            v = np.repeat(q[:10], 1000, axis=0) if copies else unit(rng.normal(size=(10_000, 16)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(10_000) + 10_000 * i), pa.FixedSizeListArray.from_arrays(v.astype(np.float32).ravel(), 16).cast(pa.list_(pa.float32()))], ["vec_id", "embedding"])

    def peak(n):
        tracemalloc.start()
        rows = sum(b.num_rows for b in search.nearest_rows(batches(n), np.arange(len(q)), q, 24))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 24 * len(q)
        return most

    small, large = peak(1), peak(6)
    assert large < 1.2 * small and large < 100e6


def test_required_are_all_vectors_of_the_label(spark, tmp_path):
    """Not those of 40 ids, nor the next two ids; without a label none. A vector of its own label is found first."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), None if i == 20 else i % 3) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 100, 20):
        near = np.lexsort((np.arange(100), -np.round(v @ v[q], 6)))[:10]
        label = rows[q][2]
        own = [r[0] for r in rows if r[2] == label]
        want[q] = 1.0 if label is None else round(len(set(own) & set(near.tolist())) / len(own), 6)
    assert {r.query_id: r.recall for r in QUERIES["e07_recall"](spark, str(tmp_path)).collect()} == want
    assert {r.query_id: r.rr for r in QUERIES["e09_reciprocal_rank"](spark, str(tmp_path)).collect()} == {0: 1.0, 20: 0.0, 40: 1.0, 60: 1.0, 80: 1.0}


def test_text_search_shuffles_ranks_alone(spark):
    """Candidates carried their whole vectors through two shuffles; now k rows a task and question are all that moves."""
    texts = ["cats and a well-known dog", None, "", "dogs, Dogs: fox@den.org", "the cat sat on the hats", *(f"cat hat w{i}" for i in range(60))]
    chunks = spark.createDataFrame([(f"c:{i}", t) for i, t in enumerate(texts)], "chunk_id string, content string").repartition(3)
    asked = ["cat or dog", '"known dog" or hat', "cat -hat", "-cat", "dog well-known", None, "or", "w7 or w8 or w9 cat"]
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.search(questions, chunks).collect()}
    want = {(q, f"c:{c}"): round(x, 6) for q, a in enumerate(asked) if (s := lexical.parse_search(a)) for c, t in enumerate(texts) if (x := lexical.cover_score(s, lexemes.vector(t))) is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert {(r.query_id, r.chunk_id) for r in lexical.search(questions, chunks, scored=False).collect()} == want.keys()
    best = lexical.search_top_k(questions, chunks, 5)
    top = [(q, *x) for q in range(len(asked)) for x in sorted((-want[k], k[1]) for k in want if k[0] == q)[:5]]
    assert sorted((r.query_id, -r.score, r.chunk_id) for r in best.collect()) == sorted(top)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_fused_candidates_are_written_once(spark):
    """Joins with the chunks planned shuffles of all texts; a written table's size lets its rows go to the texts."""
    found = retrieval.candidates(spark, SF)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_table_rows_split_a_line_once(spark):
    """Every use of the words split the whole line anew, in a query of two columns dozens of times."""
    df = QUERIES["i16_table_row"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(coalesce(") <= 2


def found_in_slices(monkeypatch, asked, texts, k, scored=True):
    """The step of text search over slices of 100 chunks: matches as (question, chunk id, score), and how many were looked at."""
    monkeypatch.setattr(lexical, "SLICE", 100)
    items = [{"query_id": q, "branch": n, **i} for q, a in enumerate(asked) for n, b in enumerate(lexical.parse_search(a)) for i in b]
    kind = pa.schema([("query_id", pa.int64()), ("branch", pa.int32()), ("unwanted", pa.bool_()), ("lexemes", pa.list_(pa.string())), ("offsets", pa.list_(pa.int32()))])
    of, ids = lexical._Asked(pa.Table.from_pylist(items, kind), k, scored), pa.array([f"c:{i}" for i in range(len(texts))])
    batches = (pa.record_batch([ids[i : i + 50], pa.array(texts[i : i + 50], pa.string())], ["chunk_id", "content"]) for i in range(0, len(texts), 50))
    best, before, seen, out = lexical._Best(len(of.ids), k) if k else None, 0, 0, set()
    rank = pa.compute.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    for own, places in lexical._slices(batches, of, False):
        matches = lexical._Matches(of, places, k, rank[before:])
        for q, row, wide in matches.runs(0, len(of.ids), 1000):
            seen += len(q)
            q, row, score = matches.scores(q, row, wide) if scored else (q, row, np.zeros(len(q)))
            if best:
                best.add(0, q, row + before, score, rank)
            else:
                out |= {(int(of.ids[x]), ids[int(y) + before].as_py(), float(z)) for x, y, z in zip(q, row, score)}
        before += len(own)
    for q, place, score in best.held.values() if best else ():
        out |= {(int(of.ids[x]), ids[int(y)].as_py(), float(z)) for x, y, z in zip(q, place, score)}
    return out, seen


def test_ranking_does_not_look_at_every_match(monkeypatch):
    """Questions times matches grew with the square of the input: of a lone lexeme only the best rows of a slice are scored."""
    rng = random.Random(8)
    texts = ["common " * rng.randrange(1, 4) + rng.choice(["", "usual", "rare word", "word"]) for _ in range(2000)]
    asked = ["common", "common or usual", "common usual or word", "rare word or usual or missing"]
    got, seen = found_in_slices(monkeypatch, asked, texts, 5)
    every = {(q, f"c:{c}"): round(x, 6) for q, a in enumerate(asked) for c, t in enumerate(texts) if (x := lexical.cover_score(lexical.parse_search(a), lexemes.vector(t))) is not None}
    assert got == {(q, c, x) for q in range(4) for c, x in sorted(((c, x) for (o, c), x in every.items() if o == q), key=lambda y: (-y[1], y[0]))[:5]}
    assert len(every) > 5500 and seen < 2500


def test_search_of_many_forms(monkeypatch):
    rng = random.Random(9)
    words = "running runs cats dog the of hats tied nation relational fox-den a-b-c x@y.org".split()
    texts = [None, "", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(300))]
    forms = [*[lambda: rng.choice(words)] * 4, lambda: "or", lambda: '"' + " ".join(rng.sample(words, rng.randrange(2, 4))) + '"', lambda: "-" + rng.choice(words)]
    asked = [" ".join(rng.choice(forms[: 5 if i % 2 else 7])() for _ in range(rng.randrange(0, 8))) for i in range(300)] + ["-dog", " ".join(f"z{i}" for i in range(20)) + " or dog"]
    held = [lexemes.vector(t) for t in texts]
    every = {(q, f"c:{c}"): round(x, 6) for q, a in enumerate(asked) if (s := lexical.parse_search(a)) for c, h in enumerate(held) if (x := lexical.cover_score(s, h)) is not None}
    assert found_in_slices(monkeypatch, asked, texts, None)[0] == {(*k, x) for k, x in every.items()}
    assert {x[:2] for x in found_in_slices(monkeypatch, asked, texts, None, False)[0]} == every.keys()
    best = {(q, c, x) for q in range(len(asked)) for c, x in sorted(((c, x) for (o, c), x in every.items() if o == q), key=lambda y: (-y[1], y[0]))[:7]}
    assert found_in_slices(monkeypatch, asked, texts, 7)[0] == best


def test_texts_are_read_once_for_many_questions(spark):
    questions = spark.range(40000).selectExpr("id AS query_id", "concat('w', id) AS question")
    found = lexical.search(questions, spark.createDataFrame([(1, "w7 w39999")], "chunk_id long, content string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in found.collect()} == {(7, 1, 0.1), (39999, 1, 0.1)}


def test_phrases_are_found_where_they_stand(monkeypatch):
    """A phrase was sought in every row that holds its words."""
    texts = ["common x usual"] * 300 + ["x common usual", "usual common of usual", "common usual-common"]
    asked = ['"common usual"', '"usual common of usual" or missing', '"x common usual" -missing']
    cost, plain = [], lexical._Matches.__init__
    monkeypatch.setattr(lexical._Matches, "__init__", lambda self, *a: (plain(self, *a), cost.append(self.cost[-1]))[0])
    got, _ = found_in_slices(monkeypatch, asked, texts, None, False)
    assert {x[:2] for x in got} == {(0, "c:300"), (1, "c:301"), (2, "c:300")} and sum(cost) <= 4

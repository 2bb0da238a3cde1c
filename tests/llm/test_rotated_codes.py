"""Rotated one-bit codes against brute force: recall, ties, copies, unusable vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex.llm import rotated_codes
from corvex.llm.queries import QUERIES
from tests.oracle import SF

SCHEMA = "vec_id long, embedding array<float>, label int, score double, q string"


def brute(rows, is_query, k=10):
    """rows: (vec_id, vector) without repeats."""
    use = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for n, (i, v) in enumerate(use):
        if is_query(i):
            near = sorted((math.sqrt(((v - w) ** 2).sum()), j) for m, (j, w) in enumerate(use) if m != n and len(w) == len(v))[:k]
            out[i] = [(r, j, s) for r, (s, j) in enumerate(near, 1)]
    return out


def got_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({x[1] for x in got.get(q, [])} & {x[1] for x in near}) for q, near in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_op13_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    got = got_of(QUERIES["op13_nearest"](spark, sf))
    assert got.keys() == want.keys() and recall(got, want) >= 0.99
    by_id = dict(rows)
    for q, near in got.items():
        assert [r for r, *_ in near] == list(range(1, 11)) and near == sorted(near, key=lambda x: (x[2], x[1])) and q not in {j for _, j, _ in near}
        for _, j, s in near:
            assert s == pytest.approx(math.dist(by_id[q], by_id[j]), rel=1e-12)


def test_op13_copies_ties_and_unusable(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(1000, 1500)]
    rows += [(2000, None), (2010, []), (2020, [0.0] * 6), (2030, [nan] + [1.0] * 5), (2040, [inf] + [1.0] * 5), (2050, [None] + [1.0] * 5), (None, [1.0] * 6), (2060, [1.0, 0.5]), (2070, [-1.0, 0.5]), (2080, [3.0])]
    want = brute(rows, lambda i: i % 10 == 0)
    df = spark.createDataFrame([(i, v, 0, 0.0, "x") for i, v in rows + rows[:40] + [rows[300]] * 50], SCHEMA).repartition(7)
    got = got_of(rotated_codes.nearest(df, F.col("vec_id") % 10 == 0, epsilon=50.0))
    assert {q: [(r, j, round(s, 9)) for r, j, s in near] for q, near in got.items()} == {q: [(r, j, round(s, 9)) for r, j, s in near] for q, near in want.items() if near}
    assert recall(got_of(rotated_codes.nearest(df, F.col("vec_id") % 10 == 0)), want) >= 0.95


def test_op13_small_blocks_change_nothing_measured(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 0, 0.0, "x") for i, v in enumerate(rng.standard_normal((900, 24)) * 1e3 + 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r[:2] for r in rows], lambda i: i % 3 == 0)
    for name, value in (("LEAST_ROWS", 64), ("MOST_ROWS", 64), ("QUERIES", 50), ("AT_ONCE", 500)):
        monkeypatch.setattr(rotated_codes, name, value)
    assert recall(got_of(rotated_codes.nearest(df, F.col("vec_id") % 3 == 0)), want) >= 0.99


def test_op13_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((2000, 100)) + 3, rng.standard_normal((20, 100)) + 3
    centre = x.mean(0)
    estimate, error = rotated_codes.bounds(*rotated_codes.encode(x, centre), q, centre)
    true = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (np.abs(estimate - true) <= error).mean() > 0.93 and abs((estimate - true).mean()) < 0.02 * true.mean()
    code, norm, factor = rotated_codes.encode(centre[None], centre)
    estimate, error = rotated_codes.bounds(code, norm, factor, q, centre)
    assert np.allclose(estimate[:, 0], ((q - centre) ** 2).sum(1)) and not error.any()


def test_op13_most_are_not_measured():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((5000, 256))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:20] + rng.standard_normal((20, 256)) * 0.02
    index = rotated_codes.encode(x, np.zeros(256))
    assert np.mean([len(rows) for rows, _ in rotated_codes.search(x, index, q, np.zeros(256), 1)]) < 50


def test_op13_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rotated_codes.nearest(none, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0, 0.0, "x")], SCHEMA)
    assert rotated_codes.nearest(one, F.col("vec_id") % 100 == 0).count() == 0

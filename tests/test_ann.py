"""Lists around trained centroids: recall against the exact search, share of rows read, blocks, unusable vectors."""

import numpy as np
import pytest

from corvex.operators import ann, search
from corvex.catalog import QUERIES
from tests.oracle import SF

SCHEMA = "vec_id long, embedding array<float>"


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    exact = pairs(QUERIES["d01_vector_top_k"](spark, sf))
    found = QUERIES["d03_vector_approximate"](spark, sf).collect()
    assert len({(r.query_id, r.vec_id) for r in found} & exact) / len(exact) >= 0.9
    assert all(r.rank <= 24 for r in found) and len({(r.query_id, r["rank"]) for r in found}) == len(found)


def clustered(rng, n, clusters, dim=48):
    centres = rng.standard_normal((clusters, dim)) * 4
    return centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim))


def test_clustered_vectors_read_a_small_share(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = clustered(rng, 6000, 60)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA).repartition(5)
    asked = df.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    exact = pairs(search.vector_top_k(asked, df, 10))
    index = ann.build(df, 10)
    near = ann._nearest(ann.unit(v[::20]), index.centroids, index.probes)
    assert index.share_read(near) < 0.1 and len(pairs(ann.search(asked, index, 10)) & exact) / len(exact) >= 0.95
    whole = {(r.query_id, r.vec_id, r.score, r["rank"]) for r in ann.search(asked, index, 10).collect()}
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_QUESTIONS", 30)
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in ann.search(asked, ann.build(df, 10), 10).collect()} == whole


def test_unusable_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, 1.0])], SCHEMA)
    asked = df.where("vec_id IN (1, 2, 3)").selectExpr("vec_id AS query_id", "embedding AS vector")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(asked, ann.build(df), 5).orderBy("rank").collect()] == [(1, 1, 1.0), (1, 5, 0.707107)]
    none = df.where("false")
    assert ann.search(asked, ann.build(none)).count() == 0

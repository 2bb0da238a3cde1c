"""Approximate nearest vectors by a trained coarse quantiser: lists around centroids, of which a question reads the nearest few.

Centroids, and how many lists a question has to read, are fitted on a bounded sample: the fewest lists that hold the wanted
share of the sample's own true neighbours. On clustered vectors that is a small part of the table; where directions are
evenly spread no list tells more than another, and most have to be read. The index is written once; large lists are cut
into blocks, so no task holds more than a block of rows and a block of questions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.operators.search import ranked
from corvex.shared import written

SAMPLE, TESTED, ROUNDS = 16_384, 256, 12  # rows of the sample, its questions for the number of lists, k-means rounds
MOST_LISTS = 1024
BLOCK_ROWS, BLOCK_QUESTIONS = 16_384, 2048


@dataclass
class Index:
    """rows: list, block, vec_id and unit vector, written. blocks: how many blocks each list has (MOST_LISTS at most)."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int
    blocks: dict[int, int]
    sizes: dict[int, int]

    def share_read(self, nearest: np.ndarray) -> float:
        """The share of all rows in the lists of `nearest` (questions x probes), on average."""
        return float(np.mean([sum(self.sizes.get(int(n), 0) for n in row) for row in nearest]) / max(1, sum(self.sizes.values())))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, nearest first."""
    score = vectors @ centroids.T
    return np.argsort(-score, axis=1, kind="stable")[:, :n]


def train(sample: np.ndarray, lists: int, k: int, recall: float) -> tuple[np.ndarray, int]:
    """Centroids (spherical k-means) and the number of lists to read for the recall within the sample."""
    rng = np.random.default_rng(3)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centroids)
    own = (sample @ centroids.T).argmax(1)
    asked = rng.choice(len(sample), min(TESTED, len(sample)), replace=False)
    near = np.argsort(-(sample[asked] @ sample.T), axis=1, kind="stable")[:, :k]
    rank = np.argsort(_nearest(sample[asked], centroids, len(centroids)), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return centroids, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def build(vectors: DataFrame, k: int = 24, recall: float = 0.97) -> Index:
    """The index of vectors (vec_id, embedding of one length). Null, empty and zero vectors are left out."""
    usable = vectors.select("vec_id", "embedding").where(F.exists("embedding", lambda x: x != 0))
    rows = vectors.count()
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // SAMPLE)))
    held = usable.where(part == 0).limit(2 * SAMPLE).toPandas()
    if not len(held):
        return Index(usable.select(F.lit(0).alias("list"), F.lit(0).alias("block"), "vec_id", F.col("embedding").cast("array<double>").alias("unit")), np.zeros((1, 1)), 1, {}, {})
    sample = unit(np.stack(held.sort_values("vec_id")["embedding"].to_numpy()).astype(np.float64))
    centroids, probes = train(sample, min(MOST_LISTS, max(1, math.isqrt(rows))), k, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array((v @ centroids.T).argmax(1).astype(np.int32)), batch.column(0), lists], ["list", "vec_id", "unit"])

    assigned = written(usable.mapInArrow(assign, "list int, vec_id long, unit array<double>"), "lists")
    sizes = {r["list"]: r["count"] for r in assigned.groupBy("list").count().collect()}  # MOST_LISTS at most
    blocks = {n: max(1, math.ceil(size / BLOCK_ROWS)) for n, size in sizes.items()}
    return Index(assigned, centroids, probes, blocks, sizes)


def search(questions: DataFrame, index: Index, k: int = 24) -> DataFrame:
    """query_id, vec_id, score (cosine, 6 decimals) and rank of the k nearest rows found; ties by vec_id."""
    if not index.sizes:
        return questions.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    spark = questions.sparkSession
    cuts = spark.createDataFrame([(n, b) for n, b in index.blocks.items()], "list int, blocks int")
    centroids, probes = index.centroids, index.probes
    query_blocks = max(1, math.ceil(questions.count() / BLOCK_QUESTIONS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                near = _nearest(v, centroids, probes)
                at = np.repeat(np.arange(len(v)), near.shape[1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * v.shape[1] + 1, v.shape[1]), pa.int32()), pa.array(v[at].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(near.ravel().astype(np.int32)), lists], ["query_id", "q_list", "vector"])

    numbered = lambda of, n: F.pmod(F.xxhash64(of), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = questions.select("query_id", "vector").where(F.exists("vector", lambda x: x != 0)).mapInArrow(probe, "query_id long, q_list int, vector array<double>")
    right = asked.join(F.broadcast(cuts.withColumnRenamed("list", "q_list")), "q_list").withColumn("q_b", numbered("query_id", F.lit(query_blocks))).withColumn("q_a", every(F.col("blocks"))).drop("blocks")
    left = index.rows.join(F.broadcast(cuts), "list").withColumn("a", numbered("vec_id", F.col("blocks"))).withColumn("b", every(F.lit(query_blocks))).drop("blocks")

    def best(rows: pa.Table, these: pa.Table) -> pa.Table:
        out: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if rows.num_rows and these.num_rows:
            matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            score, ids = np.round(matrix(these, "vector") @ matrix(rows, "unit").T, 6), rows.column("vec_id").to_numpy()
            order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            out = (np.repeat(these.column("query_id").to_numpy(), order.shape[1]), ids[order].ravel(), np.take_along_axis(score, order, 1).ravel())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.groupBy("list", "a", "b").cogroup(right.groupBy("q_list", "q_a", "q_b")).applyInArrow(best, "query_id long, vec_id long, score double")
    return ranked(found, "query_id", "score", "vec_id", k)

"""Approximate nearest neighbours by randomly rotated one-bit codes (after Gao and Long, 2024).

A vector's direction from a centre is turned by a random rotation, and the signs of what comes out are its code. With the
distance to the centre and the code's inner product with the direction itself, the inner product of the direction with any
query is estimated without bias from the bits, with an error that is almost always within a bound. In each block the
vectors of smallest estimated distance are measured exactly; of the others, only those whose lower bound does not exceed
the k-th of these distances are measured too.

Copies are one vector of the index, with their smallest ids: more than k + 1 of them are in no result. Queries, also one for
all copies, meet the index in blocks of bounded size, so no task holds more than two blocks, and a block passes on k + 1 rows
a query. Work is queries times vectors, as nothing narrows the search where directions are evenly spread; what a vector costs is a
product with its bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvex.llm.common import cut, give_back

EPSILON = 1.9  # the error bound in standard deviations of the estimate
SAMPLE = 4096  # vectors whose mean is the centre, about
QUERIES, LEAST_ROWS, MOST_ROWS = 2048, 1024, 1 << 16  # queries in a block; rows in a block, about
AT_ONCE = 1 << 21  # estimates in memory
FIRST = 2  # times k estimates that are measured first
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (dim, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
        _rotations[dim, seed] = q * np.sign(np.diag(r))
    return _rotations[dim, seed]


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances to the centre, and the inner products of codes with their directions (1 at the centre itself)."""
    away = vectors - centre
    norm = np.sqrt((away**2).sum(1))
    turned = away @ rotation(vectors.shape[1]).T
    kept = np.abs(turned).sum(1) / math.sqrt(vectors.shape[1])
    factor = np.divide(kept, norm, out=np.ones_like(norm), where=norm > 0)
    return np.packbits(turned > 0, axis=1), norm, factor


def bounds(codes: np.ndarray, norm: np.ndarray, factor: np.ndarray, queries: np.ndarray, centre: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances (queries x codes), and how much less they may be."""
    dim = queries.shape[1]
    away = queries - centre
    far = np.sqrt((away**2).sum(1))
    turned = np.divide(away, far[:, None], out=np.zeros_like(away), where=far[:, None] > 0) @ rotation(dim).T
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    inner = turned.astype(np.float32) @ signs.T
    scale = 2 * norm * far[:, None]
    error = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * epsilon / math.sqrt(max(1, dim - 1))
    return norm**2 + far[:, None] ** 2 - scale * (inner / factor), scale * error


def search(vectors: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, centre: np.ndarray, k: int, epsilon: float = EPSILON) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows measured that may be among its k nearest, and their exact distances."""
    exact = lambda rows, q: np.sqrt(((vectors[rows] - q) ** 2).sum(1))
    step = max(1, AT_ONCE // max(1, len(vectors)))
    for i in range(0, len(queries), step):
        some = queries[i : i + step]
        estimate, error = bounds(*index, some, centre, epsilon)
        lower = estimate - error
        first = min(FIRST * k, len(vectors))
        nearest = np.argpartition(estimate, first - 1, 1)[:, :first]
        for q, low, rows in zip(some, lower, nearest):
            found = exact(rows, q)
            kth = np.partition(found, k - 1)[k - 1] if len(found) >= k else np.inf
            low[rows] = np.nan
            more = np.flatnonzero(low <= kth**2 * (1 + 1e-5))
            yield np.concatenate([rows, more]), np.concatenate([found, exact(more, q)])


def _usable(vector: Column) -> Column:
    """Without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _centres(usable: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """By dimension the mean of about SAMPLE distinct vectors, chosen by their hash; a dimension without any has its centre at zero."""
    chosen = usable.where(F.pmod(F.xxhash64("embedding"), F.lit(max(1, rows // SAMPLE))) == 0).select("embedding").distinct().limit(4 * SAMPLE)
    by: dict[int, list] = {}
    for v in sorted(tuple(r[0]) for r in chosen.collect()):
        by.setdefault(len(v), []).append(v)
    return {d: np.mean(np.array(v, np.float64), 0) for d, v in by.items()}


def _matrix(table: pa.Table | pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build_index(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The index over all usable vectors, written to the shared folder, and the centres by dimension.

    One row for each different vector: dim, code, norm, factor, its k + 1 smallest ids, and the vector itself.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    centres = _centres(usable, vectors.count())
    # the limit on the rank works before the shuffle: a task sends at most so many ids of a vector
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    classes = usable.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    schema = T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("factor", T.DoubleType()),
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("embedding", usable.schema["embedding"].dataType),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                code, norm, factor = encode(_matrix(part, "embedding", dim), centres.get(dim, np.zeros(dim)))
                columns = [pa.array(np.full(len(norm), dim, np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(factor), part.column(1), part.column(0)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        give_back()

    return cut(classes.mapInArrow(run, schema), "codes"), centres


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """For every row with is_query its k nearest other rows: query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    Ties go to the smaller vec_id. Null and zero vectors, vectors with null or non-finite components, and rows without an id
    take no part. Vectors of another length are never neighbours. Rows that repeat an id and its vector count once; an id
    with two vectors is two rows. Fewer than k candidates are all returned. Other columns are left out.
    """
    index, centres = build_index(vectors, k, id_col, vector_col)
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("embedding")).where(F.col("query_id").isNotNull() & _usable(F.col("embedding")))
    queries = cut(asked.groupBy("embedding").agg(F.min("query_id").alias("q")), "queries")
    rows, n_queries = index.count(), queries.count()
    per_block = min(MOST_ROWS, max(LEAST_ROWS, int(8 * math.sqrt(rows))))
    row_blocks, query_blocks = max(1, math.ceil(rows / per_block)), max(1, math.ceil(n_queries / QUERIES))
    block = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("a", block("embedding", row_blocks)).withColumn("b", every(query_blocks))
    right = queries.select(F.size("embedding").alias("q_dim"), every(row_blocks).alias("q_a"), block("embedding", query_blocks).alias("q_b"), "q", F.col("embedding").alias("vector"))
    out = "q long, vec_id long, score double"

    def one(key: tuple, some: pa.Table, these: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if some.num_rows and these.num_rows:
            dim = some.column("dim")[0].as_py()
            own, centre = _matrix(some, "embedding", dim), centres.get(dim, np.zeros(dim))
            codes = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
            ids = some.column("ids").combine_chunks()
            flat, n = ids.flatten().to_numpy(), ids.value_lengths().to_numpy()
            first = np.cumsum(n) - n
            index_ = (codes, some.column("norm").to_numpy(), some.column("factor").to_numpy())
            for q, (at, score) in zip(these.column("q").to_pylist(), search(own, index_, _matrix(these, "vector", dim), centre, k + 1, epsilon)):
                close = np.argsort(score, kind="stable")
                if len(close) > k + 1:  # further ones only if they tie
                    close = close[score[close] <= score[close[k]]]
                each = n[at[close]]
                ids_ = flat[np.repeat(first[at[close]] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                scores = np.repeat(score[close], each)
                best = np.lexsort((ids_, scores))[: k + 1]
                found.append((np.full(len(best), q), ids_[best], scores[best]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        q, ids_, scores = (np.concatenate([none[j], *(f[j] for f in found)]) for j in range(3))
        return pa.table({"q": pa.array(q, pa.int64()), "vec_id": pa.array(ids_, pa.int64()), "score": pa.array(scores, pa.float64())})

    near = left.groupBy("dim", "a", "b").cogroup(right.groupBy("q_dim", "q_a", "q_b")).applyInArrow(one, out)
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    best = near.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    # copies of a query share its neighbours; both sides of the joins come from exchanges, so that a hot one can be split
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = asked.distinct().repartition(parts).join(queries, "embedding").select("query_id", "q").repartition(parts).join(best.repartition(parts), "q")
    others = F.filter("near", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["score"] == 0)))
    return of.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")

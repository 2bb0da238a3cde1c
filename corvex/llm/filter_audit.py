"""Filter interaction audit: which filter of a chain removes what, for every order of the filters.

Documents become masks of the filters they fail, and masks become counts by part; what follows is small. A mask matrix (0
where a mask fails a filter, infinite elsewhere) and the matrix of every filter's place in every order (the inverse
permutations) are combined by a min-plus product: the smallest place among a mask's failed filters is the step that removes
it. Those steps scatter the weights of a part into counts by order and step.

Only the shuffles by (identical text), by document id and by part remain, of rows without texts; equal texts are counted
before they are dealt out, so a text that a third of all documents share is one row a task.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.llm.common import text_of

FILTERS = "ABCDE"
WORDS, REPEATED, CAPITALS = 200, 50, 3  # fewest words, least percentage of distinct words, most percentage of capitals
MOST_FILTERS = 7  # 7! orders are 5,040 rows of steps a part
NEVER = np.iinfo(np.int64).max // 2
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders_of(n: int) -> np.ndarray:
    """All orders of n filters, one a row, in lexicographic sequence."""
    return np.array(list(permutations(range(n))), np.int64)


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The step (from 0) at which each order removes each mask; NEVER where nothing does. masks: booleans by filter."""
    places = np.argsort(orders, 1)  # inverse permutations: the place of each filter
    cost = np.where(masks, 0, NEVER)
    return np.minimum.reduce([cost[:, f, None] + places[None, :, f] for f in range(masks.shape[1])]).clip(max=NEVER)


def step_counts(masks: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by order and step for rows of failed filters (booleans) with weights (documents, good, toxic)."""
    n = masks.shape[1]
    orders = orders_of(n)
    steps = removal_steps(masks, orders)
    each = np.arange(len(orders))
    gone = np.zeros((len(orders), n, weights.shape[1]), np.int64)
    row, order = np.nonzero(steps < NEVER)
    np.add.at(gone, (order, steps[row, order]), weights[row])
    failed = masks.T.astype(np.int64) @ weights[:, 0]
    alone = (masks & (masks.sum(1) == 1)[:, None]).T.astype(np.int64) @ weights[:, 0]
    removed = gone[:, :, 0]
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, removed)
    return {
        "order": np.repeat(each, n), "filter": orders.ravel(), "kept": (weights[:, 0].sum() - removed.cumsum(1)).ravel(), "removed": removed.ravel(), "redundant": (failed[orders] - removed).ravel(),
        "unique_fails": alone[orders].ravel(), "good_lost": gone[:, :, 1].ravel(), "toxic_lost": gone[:, :, 2].ravel(), "shapley": shapley[orders].ravel(),
    }


def text_failures(text: Column) -> list[Column]:
    """The conditions A to D of a text on its own."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return [
        F.size(words) < WORDS, F.size(F.array_distinct(words)) * 100 < F.size(words) * REPEATED,
        F.char_length(F.regexp_replace(text, "[^A-Z]", "")).cast("long") * 100 > F.char_length(text).cast("long") * CAPITALS, text.rlike(r"[#$%&*|]"),
    ]


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, documents, good, toxic): documents by part and by the filters they fail (bit 0 is A).

    A document fails E if any smaller doc_id has the identical text. A row without a doc_id never fails E and has no label;
    rows that repeat a doc_id count each, and the first id of a text fails E in none of its rows. A document is good or toxic
    if any label of its id says so. Null texts count as empty ones, null parts as the empty string.
    """
    # rows without an id, which would all hash alike, are dealt by their text
    text = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("t"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_failures(F.col("t")))]
    own = text.select("id", "part", F.sha2("t", 256).alias("same"), sum(bits[1:], bits[0]).alias("own"))
    rows = own.groupBy("id", "part", "same", "own").agg(F.count("*").alias("n")).withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("same")).otherwise(F.lit(0)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    ).withColumn("salt", F.lit(0).cast("long"))
    joined = rows.join(known, ["id", "salt"], "left").fillna(False, ["good", "toxic"])
    alike = joined.groupBy("same", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("without"),
    )
    # rows of one text are few now: one for each part and label that its documents have
    seen = alike.withColumn("first", F.min("least").over(Window.partitionBy("same"))).withColumn("fresh", F.col("without") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0)))
    split = seen.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("own") + F.lit(16)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
    )).alias("x")).where("x.n > 0")
    weight = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("x.n"))), F.lit(0)).cast("long").alias(c)
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").cast("long").alias("documents"), weight("good"), weight("toxic"))


def audit(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order and step (from 1) of counts as `mask_counts` gives them. A part without documents has no rows."""
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, as every order of them is a result")

    def one(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("mask", "documents", "good", "toxic")}
        masks = (columns["mask"][:, None] >> np.arange(n)) & 1 == 1
        found = step_counts(masks, np.stack([columns[c] for c in ("documents", "good", "toxic")], 1).astype(np.int64))
        names = np.array(["".join(letters[f] for f in o) for o in orders_of(n).tolist()])
        out = {"part": pa.array([table.column("part")[0].as_py()] * len(found["order"]), pa.string()), "filter_order": pa.array(names[found["order"]].tolist(), pa.string()), "step": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names)))}
        return pa.table(out | {c: pa.array(found[c], pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")})

    return counts.groupBy("part").applyInArrow(one, RESULT)


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters over whole documents by part; an empty table has no parts and so no rows."""
    return audit(mask_counts(docs, labels, part))

"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, A-Z lower-cased. Fixed masks over a short window say which token positions count;
a window's hash under a mask ignores the others, so a substituted token that falls on an ignored position still hits.
Test hashes and training hashes are joined, and every hit is verified along its diagonal: the best stretch of aligned
tokens, where substitutions cost but do not end it, has to be long enough, or the matches of the whole diagonal have to
reach their share of the item. No stretch of 13 matches escapes the masks. Items of some lengths have masks of their own, so that no placement of the substitutions
which that share allows is without a hit. Where the test set's seeds are few (checked)
they are broadcast and training hashes never leave their task; beyond that the hashes are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.common import cut, slices, text_of
from corvex.llm.vec import U, Words, mix

# Fixed masks: 1 counts, 0 is ignored. Each position of the window is ignored by at least one mask, and every stretch of 13
# matches that best_stretch can return meets one of them (tests/llm enumerates the placements of substitutions).
MASKS = ("11011011", "10110111", "11101101", "01111110", "11101110", "11110101", "11110011")
# Further masks for items of these lengths alone: with them, an item of which a fifth is substituted keeps a hit at any placement.
LENGTHS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "10111", "11011", "11101"), 6: ("11111", "101111", "110111", "111011", "111101"), 7: ("111111", "1011111", "1101111", "1110111", "1111011", "1111101"),
           10: ("1100011",), 11: ("1101000111",), 12: ("11111",), 13: ("1011111",), 15: ("1010111",), 20: ("1011111",), 21: ("1011111",)}
_BASE = tuple(m.strip("0") for m in MASKS)  # without ignored ends, so that windows at a text's edge count
ALL_MASKS = (*_BASE, *sorted({m for own in LENGTHS.values() for m in own} - set(_BASE)))
SPAN, BROADCAST_SEEDS, MISMATCH = 8, 2_000_000, 2.0
SIGNS = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_OUT = "doc_id {id}, item_id long, n_overlap long, n_matched long, doc_token long, item_token long, share double"


def seeds(hashes: np.ndarray, offsets: np.ndarray, numbers: Iterable[int], items: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, token position, mask number) of every window inside one text, under these masks; of items, each under its own masks alone."""
    out, at, under = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number in numbers:
        mask = ALL_MASKS[number]
        starts = np.arange(max(0, len(hashes) - len(mask) + 1))
        text = np.searchsorted(offsets, starts, "right") - 1
        keep = starts + len(mask) <= offsets[text + 1]
        if items and mask not in _BASE:
            keep &= np.isin(np.diff(offsets)[text], [n for n, own in LENGTHS.items() if mask in own])
        starts = starts[keep]
        value = np.full(len(starts), number + 1, U)
        for i, bit in enumerate(mask):
            if bit == "1":
                value = value * U(0x9E3779B97F4A7C15) + hashes[starts + i]
        out.append(mix(value))
        at.append(starts)
        under.append(np.full(len(starts), number))
    return np.concatenate(out), np.concatenate(at), np.concatenate(under)


def best_stretch(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """(length, matches, first item token, first doc token) of the best aligned stretch with item[i] over doc[i + shift]."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    score = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -MISMATCH))))
    gain = score - np.minimum.accumulate(score)
    end = int(gain.argmax())
    start = int(np.flatnonzero(score[: end + 1] == score[: end + 1].min())[-1])
    return end - start, int(same[start:end].sum()), lo + start, lo + start + shift


def whole_diagonal(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """As best_stretch, from the first to the last match of the diagonal, whatever lies between."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    at = lo + np.flatnonzero(doc[lo + shift : hi + shift] == item[lo:hi])
    return (int(at[-1] - at[0]) + 1, len(at), int(at[0]), int(at[0]) + shift) if len(at) else (0, 0, lo, lo + shift)


def _verified(doc: np.ndarray, pairs: dict[int, set[int]], items: dict[int, tuple[int, np.ndarray]], least: int, part: float) -> list[tuple]:
    """The best stretch of each passage with at least `least` matches or `part` of a shorter item's tokens; failing that, a diagonal with `part` of the item's."""
    out = []
    for passage, shifts in pairs.items():
        item_id, item = items[passage]
        share = int(np.ceil(part * len(item) - 1e-9))
        stretches = [x for s in sorted(shifts) if (x := best_stretch(doc, item, s))[1] >= min(least, share)]
        stretches = stretches or [x for s in sorted(shifts) if (x := whole_diagonal(doc, item, s))[1] >= share]
        if stretches:
            n, matched, i, d = max(stretches, key=lambda x: (x[1] - MISMATCH * (x[0] - x[1]), -x[3]))
            out.append((item_id, n, matched, d, i, matched / len(item)))
    return out


def _best(found: DataFrame) -> DataFrame:
    """The best row of each document and item, whose passages may be several."""
    order = F.struct(F.expr(f"n_matched - {MISMATCH} * (n_overlap - n_matched)"), -F.col("doc_token"), -F.col("item_token"), "share")
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*found.columns[2:]), order).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    taken = ids.take(pa.array(columns[0], pa.int64()))
    return pa.RecordBatch.from_arrays([taken, *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.float64())], ["doc_id", "item_id", "n_overlap", "n_matched", "doc_token", "item_token", "share"])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  least: int = 13, part: float = 0.8, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id (long), n_overlap and n_matched tokens of the
    best stretch, its first tokens in both, and share, the matched part of the item.

    A stretch counts with at least `least` matched tokens, or `part` of the tokens of an item that has fewer; where no stretch
    does, a diagonal with `part` of the item's tokens counts from its first to its last match. Items without tokens match
    nothing. Null texts are empty; rows or items without an id are passed over; the texts of a repeated item id are passages
    of one item, of which the best counts, as of rows with one document id.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).where("doc_id IS NOT NULL")
    tests = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), text_of(item_text_col).alias("text")).where("item_id IS NOT NULL")
    tests = tests.distinct().select(F.xxhash64("item_id", "text").alias("passage"), "item_id", "text")
    schema = _OUT.format(id=own.schema["doc_id"].dataType.simpleString())

    def hashed(numbers: Iterable[int], items: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, "text"):
                words = Words(texts, signs=SIGNS)
                value, at, under = seeds(words.hashes, words.offsets, numbers, items)
                text = np.searchsorted(words.offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(at - words.offsets[text]), pa.array(under)], ["seed", batch.schema.names[0], "at", "mask"])

        return run

    test_seeds = cut(tests.select("passage", "text").mapInArrow(hashed(range(len(ALL_MASKS)), True), "seed long, passage long, at long, mask long"), "seeds")
    numbers = sorted(r["mask"] for r in test_seeds.select("mask").distinct().collect())  # len(ALL_MASKS) at most
    if test_seeds.count() > broadcast_seeds:
        return _by_shuffle(own, tests, test_seeds.drop("mask"), hashed(numbers), schema, least, part)
    rows = test_seeds.orderBy("seed", "passage", "at").toPandas()  # at most broadcast_seeds
    seed = rows["seed"].to_numpy().view(U)
    order = np.argsort(seed, kind="stable")
    seed, item_of, item_at = seed[order], rows["passage"].to_numpy()[order], rows["at"].to_numpy()[order]
    gate = np.zeros(gate_size(len(seed)), bool)
    gate[seed & U(len(gate) - 1)] = True
    item_rows = tests.join(test_seeds.select("passage").distinct(), "passage", "left_semi").toPandas()  # bounded by their seeds
    item_words = Words([t.encode() for t in item_rows["text"]], signs=SIGNS)
    items = {int(p): (int(i), item_words.hashes[a:b]) for p, i, a, b in zip(item_rows["passage"], item_rows["item_id"], item_words.offsets, item_words.offsets[1:])}
    sent = spark.sparkContext.broadcast((seed, item_of, item_at, gate, items))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, item_of, item_at, gate, items = sent.value
        for batch, texts in slices(batches, "text"):
            words = Words(texts, signs=SIGNS)
            value, at, _ = seeds(words.hashes, words.offsets, numbers)
            may = np.flatnonzero(gate[value & U(len(gate) - 1)])
            value, at = value[may], at[may]
            low, high = np.searchsorted(seed, value, "left"), np.searchsorted(seed, value, "right")
            found: dict[int, dict[int, set[int]]] = {}
            for a, i, j in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                text = int(np.searchsorted(words.offsets, a, "right")) - 1
                for k in range(i, j):
                    found.setdefault(text, {}).setdefault(int(item_of[k]), set()).add(a - int(words.offsets[text]) - int(item_at[k]))
            out = [(text, *r) for text, pairs in found.items() for r in _verified(words.hashes[words.offsets[text] : words.offsets[text + 1]], pairs, items, least, part)]
            yield _batch(batch.column(0), out)

    return _best(own.mapInArrow(probe, schema))


def gate_size(n: int) -> int:
    """Places of the gate before the search among n seeds: a power of two, 8 to 16 for a seed (65,536 to 16,777,216)."""
    return 1 << min(24, max(16, (8 * n).bit_length()))


def _by_shuffle(own: DataFrame, tests: DataFrame, test_seeds: DataFrame, hashed, schema: str, least: int, part: float) -> DataFrame:
    """For large test sets: seeds joined by shuffle, shifts per pair of document and passage, then both texts joined to them."""
    id_type = own.schema["doc_id"].dataType.simpleString()
    train = own.mapInArrow(hashed, f"seed long, doc_id {id_type}, at long, mask long").drop("mask").withColumnRenamed("at", "doc_at")
    pairs = train.join(test_seeds, "seed").groupBy("doc_id", "passage").agg(F.collect_set(F.col("doc_at") - F.col("at")).alias("shifts"))
    ready = pairs.join(tests.withColumnRenamed("text", "item_text"), "passage").join(own, "doc_id").select("doc_id", "text", "item_id", "item_text", "shifts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            out = []
            for i, (text, row) in enumerate(zip(texts, batch.select(["item_id", "item_text", "shifts"]).to_pylist(), strict=True)):
                doc, item = Words([text], signs=SIGNS).hashes, Words([row["item_text"].encode()], signs=SIGNS).hashes
                out += [(i, *r) for r in _verified(doc, {0: set(row["shifts"])}, {0: (row["item_id"], item)}, least, part)]
            yield _batch(batch.column(0), out)

    return _best(ready.mapInArrow(verify, schema))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose document overlaps a benchmark item. Rows without an id stay."""
    found = cut(find_overlaps(docs, benchmark, id_col, **options).select(F.col("doc_id").alias("__found")).distinct(), "overlaps")
    return docs.join(found, F.col(id_col) == F.col("__found"), "left_anti")

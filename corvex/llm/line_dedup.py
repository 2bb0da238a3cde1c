"""Line dedup with two Bloom filters (once seen, twice seen); only suspected repeats shuffle.

Pass 1 puts the hashes of every line key of a document into a local pair of filters, and the pairs merge by segment:
what two tasks both saw once was seen twice. Pass 2 probes the merged "twice" filter; only suspects leave the map side,
as a 128-bit digest of the whole key and the doc_id, and a group-by confirms them exactly and finds the first document.
Only documents that hold a suspect are joined with what they lose; the others pass without a shuffle. A false positive of the filter therefore costs a shuffled row and nothing else. The filter has at most MAX_BITS bits
(32 MB), so the broadcast has a fixed bound; past that size more lines are suspects and results stay the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvex.llm.common import WHITE, cut, slices, text_of, with_columns
from corvex.llm.vec import U, mix

MIN_BITS, MAX_BITS, SEGMENT_WORDS = 1 << 20, 1 << 28, 1 << 15
_SEEN = "segment int, at binary, once binary, twice binary"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of every line, None for one that is too short to count."""
    keys = [x.strip(WHITE) for x in text.lower().split(b"\n")]  # bytes.lower() maps A-Z alone
    return [k if len(k) >= 4 * min_chars or (len(k) >= min_chars and len(k.decode()) >= min_chars) else None for k in keys]


def _place(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A blocked Bloom filter: one 64-bit word of the filter, and four bits in it."""
    bits = mix(hashes)
    mask = np.zeros(len(hashes), U)
    for i in range(4):
        mask |= U(1) << ((bits >> U(6 * i)) & U(63))
    return (hashes % U(words)).astype(np.int64), mask


class OnceTwice:
    def __init__(self, words: int):
        self.once, self.twice = np.zeros(words, U), np.zeros(words, U)

    def add(self, hashes: np.ndarray) -> None:
        """hashes: each stands for one document that holds the key."""
        hashes, counts = np.unique(hashes, return_counts=True)
        at, mask = _place(hashes, len(self.once))
        again = (counts > 1) | ((self.once[at] & mask) == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def merge(self, at: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice[at] |= twice | (self.once[at] & once)
        self.once[at] |= once


def _sparse(segment: int, pair: OnceTwice, base: int, width: int):
    once, twice = pair.once[base : base + width], pair.twice[base : base + width]
    at = np.flatnonzero(once).astype(np.int32)
    return {"segment": segment, "at": at.tobytes(), "once": once[at].tobytes(), "twice": twice[at].tobytes()} if len(at) else None


def twice_filter(docs: DataFrame, words: int, min_chars: int) -> np.ndarray:
    """The merged "twice" filter of the line keys of docs (columns doc_id, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = OnceTwice(words)
        for _, texts in slices(batches, "text"):
            pair.add(np.array([xxhash.xxh3_64_intdigest(k) for t in texts for k in {k for k in line_keys(t, min_chars) if k}], U))
        for s in range(0, words, SEGMENT_WORDS):
            if row := _sparse(s // SEGMENT_WORDS, pair, s, SEGMENT_WORDS):
                yield pa.RecordBatch.from_pylist([row], schema=seen)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, OnceTwice] = {}
        for batch in batches:
            for row in batch.to_pylist():
                pair = held.setdefault(row["segment"], OnceTwice(SEGMENT_WORDS))
                pair.merge(np.frombuffer(row["at"], np.int32), np.frombuffer(row["once"], U), np.frombuffer(row["twice"], U))
        for segment, pair in held.items():
            pair.once = pair.twice
            if row := _sparse(segment, pair, 0, SEGMENT_WORDS):
                yield pa.RecordBatch.from_pylist([row], schema=seen)

    seen = to_arrow_schema(T._parse_datatype_string(_SEEN))
    parts = docs.mapInArrow(build, _SEEN).repartition(max(1, words // SEGMENT_WORDS), "segment").mapInArrow(merge, _SEEN)
    out = np.zeros(words, U)
    for row in parts.select("segment", "at", "twice").toLocalIterator():
        out[row["segment"] * SEGMENT_WORDS + np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["twice"], U)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, bits_per_document: int = 256) -> DataFrame:
    """Drop every line whose key (stripped, A-Z lower-cased, at least min_chars code points) stands in a document with a smaller id.

    Returns the columns of docs, text_col holding the kept lines joined by newlines, and n_lines and n_dropped (which
    replace columns of these names). A null text is one empty line, and comes back as the empty text. Rows without an id
    neither hold lines nor lose any; rows that share an id are one document. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    bits = min(MAX_BITS, max(MIN_BITS, 1 << max(1, docs.count() * bits_per_document).bit_length()))
    words = bits // 64
    twice = spark.sparkContext.broadcast(twice_filter(keyed, words, min_chars))
    id_type = keyed.schema["doc_id"].dataType

    def suspected(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Keys of the texts' lines that the filter suspects, each once a text, and the numbers of their texts."""
        seen, keys, rows = twice.value, [], []
        for i, t in enumerate(texts):
            own = {k for k in line_keys(t, min_chars) if k}
            keys += own
            rows += [i] * len(own)
        at, mask = _place(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], U), words)
        hit = np.flatnonzero((seen[at] & mask) == mask)
        return [keys[i] for i in hit], np.array(rows, np.int64)[hit]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            keys, rows = suspected(texts)
            digests = [hashlib.blake2b(k, digest_size=16).digest() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).take(pa.array(rows))], ["digest", "doc_id"])

    found = cut(keyed.mapInArrow(suspects, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("doc_id", id_type)])), "suspects")
    firsts = cut(found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "repeats")
    drops = found.join(firsts, "digest").where("doc_id > first").groupBy(F.col("doc_id").alias("__drop_id")).agg(F.collect_set("digest").alias("__drops"))

    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    fields = [docs.schema[c] if c != text_col else T.StructField(c, T.StringType()) for c in kept_columns]
    out = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    arrow = to_arrow_schema(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col):
            drops = batch.column(batch.schema.get_field_index("__drops")).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(texts, drops, strict=True):
                n_lines.append(text.count(b"\n") + 1)
                if not gone:
                    kept.append(text.decode())
                    n_dropped.append(0)
                    continue
                gone = set(gone)
                lines = text.split(b"\n")
                keys = line_keys(text, min_chars)
                stay = [x for x, k in zip(lines, keys, strict=True) if k is None or hashlib.blake2b(k, digest_size=16).digest() not in gone]
                kept.append(b"\n".join(stay).decode())
                n_dropped.append(len(lines) - len(stay))
            yield with_columns(batch, arrow, **{text_col: kept, "n_lines": n_lines, "n_dropped": n_dropped})

    def part(suspect: bool):
        """Rows that hold a suspect, or the others, which lose nothing."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, text_col):
                has = np.zeros(len(texts), bool)
                has[suspected(texts)[1]] = True
                has &= batch.column(batch.schema.get_field_index(id_col)).is_valid().to_numpy(zero_copy_only=False)
                rows = batch.filter(pa.array(has if suspect else ~has))
                yield rows if suspect else with_columns(rows, arrow, n_lines=[t.count(b"\n") + 1 for t, x in zip(texts, has) if not x], n_dropped=np.zeros(rows.num_rows, np.int64))

        return run

    ready = docs.select(*kept_columns).withColumn(text_col, text_of(text_col))
    touched = ready.mapInArrow(part(True), ready.schema).join(drops, F.col(id_col) == F.col("__drop_id"), "left").drop("__drop_id")
    return touched.mapInArrow(apply, out).unionByName(ready.mapInArrow(part(False), out))

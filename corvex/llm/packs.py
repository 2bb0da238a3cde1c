"""Documents in packs, for operators that ask every other pack about what one pack holds.

A pack is a bounded run of rows of one input partition, its texts compressed together; the packs are written once, so a
pack reads the same in every later step. A pack sends requests to shards (bundles of sorted keys, arrays in one blob),
shards answer with blobs in the order of the request, and the answers join the pack again. Rows that move are few and
large, and no key's rows ever meet in one place other than its packs' bundles.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.common import cut, text_of

PACK_BYTES, PACK_ROWS = 8 << 20, 4096


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob, bytes of equal significance together."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(struct.pack("<3sQ", a.dtype.str[1:].ljust(3).encode(), len(a)))
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<3sQ", raw, at)
        dtype = np.dtype(kind.decode().strip())
        at += 11
        size = n * dtype.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n).T).reshape(-1).view(dtype))
        at += size
    return out


def texts_of(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<Q", raw)[0]
    ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8)).tolist()
    first = 8 + 8 * n
    return [raw[first + a : first + b] for a, b in zip([0, *ends], ends)]


def runs(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first number, texts) of runs of about `limit` bytes."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield start, texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def build_packs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """pack (long), ids (array<long>) and blob of all rows of docs; a null text is empty. Written to the shared folder.

    Small packs need less memory, large ones ask for fewer keys in all.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            body = b"".join([struct.pack("<Q", len(texts)), np.array([len(t) for t in texts], np.int64).tobytes(), *texts])
            blob = zstandard.ZstdCompressor(level=3).compress(body)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["pack", "ids", "blob"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= pack_bytes or len(ids) >= PACK_ROWS:
                    yield out()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield out()

    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(pack, "pack long, ids array<long>, blob binary"), "packs")


def shard_count(docs: DataFrame, rows_per_shard: int = 2048) -> int:
    return max(8, -(-docs.count() // rows_per_shard))


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) for keys, positions in the order of the keys."""
    shard = ((keys >> np.uint64(11)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(shard[part[0]]), part


def bundles(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows of longs and one last blob, as a batch."""
    names = names.split()
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names)

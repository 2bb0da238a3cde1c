"""SimHash near-dedup over vantage-point trees.

Documents with equal fingerprints count once. A forest of vantage-point trees, built from a bounded sample, partitions the
fingerprints by Hamming distance, each tree over the bits of its own mask (a pseudo-metric, so the triangle bound holds).
Leaves are the shards: a fingerprint is stored in one leaf and also visits every leaf that its ball reaches over a
boundary; of a pair in two leaves only the one with the larger leaf number visits. Within a shard all pairs are checked
over all bits, and only a spanning forest of the links leaves it, so a cluster gives as many rows as members. Shards above
a size are dealt in blocks. The links' components come from components.py.

Exact mode (`halves`): the masks split the bits, and of two fingerprints that differ in at most `distance` bits at least
one part differs in at most distance // parts; no link is lost. Wide mode (`scattered`): for a similarity as low as 0.8
no exact pruning of random fingerprints is possible, so fingerprints have more bits, and many trees over few random bits
each, without boundary visits, find a link with a stated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.common import cut, slices, text_of
from corvex.llm.components import components
from corvex.llm.vec import U, Words, mix

SAMPLES_PER_LEAF, LEAF, MOST_DEPTH, OWN_BLOCK, VISIT_BLOCK, SET_BLOCK = 4, 128, 16, 1024, 8192, 8 << 20


def simhash(text: bytes, width: int = 3, seed: int = 42, size: int = 1) -> np.ndarray:
    """64 * size bits. Bit i is set if it is set in over half of the word shingles' hashes; no words give 0.

    The first 64 bits of a shingle's hash are its XXH64 with the seed, further ones are mixed from these.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(size, U)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(width, len(words))
    whole, starts = b" ".join(words), (ends - sizes)[: len(words) - k + 1].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(whole[i:j], seed) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)], U)
    return majority(hashes, size)


def majority(hashes: np.ndarray, size: int) -> np.ndarray:
    """64 * size bits, each 1 if it is set in over half of the hashes; 64-bit hashes are mixed on where more bits are asked."""
    bits = np.zeros((size, 64), np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        for j in range(size):
            own = part if j == 0 else mix(part + U(j * 0x9E3779B97F4A7C15 % (1 << 64)))
            bits[j] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(bits * 2 > len(hashes), axis=1, bitorder="little").view(U).ravel()


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; of fewer words the whole sequence is the one shingle."""
    words = Words(texts)
    h = words.hashes
    rolled = np.zeros(max(0, len(h) - width + 1), U)
    for j in range(width):
        rolled = rolled * U(0x9E3779B97F4A7C15) + h[j : j + len(rolled)]
    out = []
    for a, b in zip(words.offsets.tolist(), words.offsets[1:].tolist()):
        own = rolled[a : b - width + 1]
        if 0 < b - a < width:
            own = np.zeros(1, U)
            for x in h[a:b]:
                own = own * U(0x9E3779B97F4A7C15) + x
            own += U(b - a)
        out.append(np.unique(mix(own)) if b > a else np.zeros(0, U))
    return out


def set_fingerprints(docs: DataFrame, width: int, size: int) -> DataFrame:
    """doc_id, key (long, a hash of the text's shingle set), fp (binary, of the set) and grams (binary: 32-bit hashes of the set, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            sets = shingle_sets(texts, width)
            key = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], U).view(np.int64)
            grams = [np.unique((x >> U(32)).astype(np.uint32)).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array([majority(x, size).tobytes() for x in sets], pa.binary()), pa.array(grams, pa.binary())], ["doc_id", "key", "fp", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp binary, grams binary")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, size: int = 1) -> DataFrame:
    """doc_id, key (long) and fp (binary) of docs (doc_id, text); the key is the fingerprint's 64 bits, or a hash of longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            found = [simhash(t, width, seed, size) for t in texts]
            key = np.array([f[0] if size == 1 else xxhash.xxh3_64_intdigest(f.tobytes()) for f in found], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array([f.tobytes() for f in found], pa.binary())], ["doc_id", "key", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp binary")


def halves(parts: int = 2) -> list[np.ndarray]:
    """Masks that split 64 bits into parts."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [np.array([(1 << j) - (1 << i)], U) for i, j in zip(edges, edges[1:])]


def scattered(trees: int, bits: int, size: int, seed: int = 7) -> list[np.ndarray]:
    """Masks of a few random bits each out of 64 * size."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        flat = np.zeros(64 * size, np.uint8)
        flat[rng.choice(64 * size, bits, replace=False)] = 1
        out.append(np.packbits(flat, bitorder="little").view(U))
    return out


class VantageTree:
    """A vantage-point tree over the distance within `mask`: node n splits at radius[n] around pivot[n]; leaves are at `depth`."""

    def __init__(self, sample: np.ndarray, mask: np.ndarray, depth: int, seed: int):
        self.mask, self.depth = mask, depth
        self.pivot, self.radius = np.zeros((1 << depth, len(mask)), U), np.zeros(1 << depth, np.int64)
        rng = np.random.default_rng(seed)
        held = {1: np.unique(sample & mask, axis=0)}
        for node in range(1, 1 << depth):
            own = held.pop(node)
            if len(own):
                tries = rng.choice(own, min(8, len(own)), replace=False)
                spread = [np.bitwise_count(own ^ p).sum(1, dtype=np.int64) for p in tries]
                cost = [np.count_nonzero(np.abs(d - np.median(d)) <= 1) for d in spread]
                best = int(np.argmin(cost))
                pivot, d = tries[best], spread[best]
                self.radius[node] = int(np.median(d))
            else:
                pivot, d = rng.integers(0, 1 << 63, len(mask), U), np.zeros(0, np.int64)
                self.radius[node] = int(np.bitwise_count(mask).sum()) // 2
            self.pivot[node] = pivot & mask
            if 2 * node < 1 << depth:
                held[2 * node], held[2 * node + 1] = own[d <= self.radius[node]], own[d > self.radius[node]]

    def _distance(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x ^ self.pivot[node]) & self.mask).sum(1, dtype=np.int64)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (self._distance(x, node) > self.radius[node])
        return node - (1 << self.depth)

    def reached(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold a point within `reach` of x[row]: branches beyond the triangle bound are pruned."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            d, r = self._distance(x[row], node), self.radius[node]
            near, far = d - reach <= r, d + reach > r
            row, node = np.concatenate([row[near], row[far]]), np.concatenate([2 * node[near], 2 * node[far] + 1])
        return row, node - (1 << self.depth)


def _forest(keys: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links own-visitor within `distance`, reduced to stars: each member and the smallest member of its local component."""
    every, at = np.unique(keys, return_inverse=True)
    own_at, visit_at, stored, visitors = at[own], at[~own], fp[own], fp[~own]
    left, right = [], []
    for i in range(0, len(visitors), 512):
        off = np.zeros((len(stored), len(visitors[i : i + 512])), np.uint16)
        for j in range(fp.shape[1]):
            off += np.bitwise_count(stored[:, None, j] ^ visitors[None, i : i + 512, j])
        o, v = np.nonzero(off <= distance)
        a, b = own_at[o], visit_at[i + v]
        left.append(a[a != b])
        right.append(b[a != b])
    a, b = np.concatenate(left or [[]]).astype(np.int64), np.concatenate(right or [[]]).astype(np.int64)
    label = np.arange(len(every))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(len(column), -1)


def link_fingerprints(distinct: DataFrame, distance: int, masks: list[np.ndarray], reach: int) -> DataFrame:
    """Links (a, b) between keys of distinct fingerprints (columns key, fp), with the components of all pairs that the forest finds."""
    spark = distinct.sparkSession
    n, trees_n = distinct.count(), len(masks)
    # no mask tells more than 2**bits points apart; nodes and sample are bounded by MOST_DEPTH, beyond which leaves grow
    depth = min(MOST_DEPTH, max(0, n // LEAF).bit_length(), min(int(np.bitwise_count(m).sum()) for m in masks))
    share = int((1 << 30) * min(1.0, (SAMPLES_PER_LEAF << max(12, depth)) / max(1, n)))
    sampled = distinct.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share).select("key", "fp").toPandas().sort_values("key")
    sample = np.frombuffer(b"".join(map(bytes, sampled["fp"])), U).reshape(-1, len(masks[0]))
    forest = spark.sparkContext.broadcast([VantageTree(sample, m, depth, seed) for seed, m in enumerate(masks)])  # trees * 2**MOST_DEPTH nodes at most

    def visits(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each tree: its number, rows, leaves, and whether the row is stored there."""
        for number, tree in enumerate(forest.value):
            home = tree.leaf(x)
            if reach == 0:
                yield number, np.arange(len(x)), home, np.ones(len(x), bool)
                continue
            row, leaf = tree.reached(x, reach)
            keep = leaf <= home[row]
            yield number, row[keep], leaf[keep], leaf[keep] == home[row[keep]]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((trees_n, 1 << depth), np.int64)
        seen = np.zeros_like(own)
        for batch in batches:
            for number, _, leaf, home in visits(_words(batch.column(0))):
                own[number] += np.bincount(leaf[home], minlength=1 << depth)
                seen[number] += np.bincount(leaf, minlength=1 << depth)
        at = np.flatnonzero(seen.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.ravel()[at]), pa.array(seen.ravel()[at])], ["shard", "own", "seen"])

    counted = distinct.select("fp").mapInArrow(tally, "shard long, own long, seen long").groupBy("shard").agg(F.sum("own").alias("own"), F.sum("seen").alias("seen"))
    grid = np.ones((2, trees_n << depth), np.int64)  # how many blocks each shard's own rows and visitors are dealt into
    for r in counted.where(f"own > {OWN_BLOCK} OR seen > {VISIT_BLOCK}").collect():
        grid[:, r["shard"]] = -(-max(1, r["own"]) // OWN_BLOCK), -(-r["seen"] // VISIT_BLOCK)
    first = np.concatenate(([0], np.cumsum(grid[0] * grid[1])))
    cells = spark.sparkContext.broadcast((grid, first))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, first = cells.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                key, fp, x = part.column(0).to_numpy(zero_copy_only=False), part.column(1), _words(part.column(1))
                for number, row, leaf, home in visits(x):
                    shard = leaf + (number << depth)
                    own_blocks, visit_blocks = grid[0][shard], grid[1][shard]
                    mixed = mix(x[row, 0])
                    mine = ((mixed >> U(7)) % own_blocks.astype(U)).astype(np.int64)
                    theirs = ((mixed >> U(29)) % visit_blocks.astype(U)).astype(np.int64)
                    alone = home & (own_blocks * visit_blocks == 1) if reach == 0 else np.zeros(len(row), bool)
                    for stored, at, times in ((True, np.flatnonzero(home), visit_blocks), (False, np.flatnonzero(~alone), own_blocks)):
                        copy = np.repeat(at, times[at])
                        turn = np.arange(len(copy)) - np.repeat(np.cumsum(times[at]) - times[at], times[at])
                        o, v = (mine[copy], turn) if stored else (turn, theirs[copy])
                        cell = first[shard[copy]] + o * visit_blocks[copy] + v
                        take = row[copy]
                        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(key[take]), fp.take(pa.array(take)), pa.array(np.full(len(copy), stored))], ["cell", "key", "fp", "own"])

    def check(table: pa.Table) -> pa.Table:
        key, own, fp = table.column("key").to_numpy(), table.column("own").to_numpy(), _words(table.column("fp").combine_chunks())
        if own.all():  # a shard of one block without visitors: its rows are compared with themselves
            key, fp, own = np.concatenate([key, key]), np.concatenate([fp, fp]), np.repeat([True, False], len(own))
        a, b = _forest(key, fp, own, distance)
        return pa.table({"a": a, "b": b})

    return distinct.select("key", "fp").mapInArrow(deal, "cell long, key long, fp binary, own boolean").groupBy("cell").applyInArrow(check, "a long, b long").distinct()


def _one_class(grams: list[np.ndarray], fp: np.ndarray, distance: int, similarity: float) -> np.ndarray:
    """The number of the first member of each member's class: classes of sets joined by pairs of the similarity and within the distance."""
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    _, token = np.unique(np.concatenate(grams), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    marked = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)
    root = np.full(len(grams), -1)
    for first in range(len(grams)):
        if root[first] >= 0:
            continue
        root[first], queue = first, [first]
        while queue:
            m = queue.pop()
            rest = np.flatnonzero(root < 0)
            small, large = np.minimum(sizes[rest], sizes[m]), np.maximum(sizes[rest], sizes[m])
            rest = rest[(np.bitwise_count(fp[rest] ^ fp[m]).sum(1, dtype=np.int64) <= distance) & (small >= similarity * large - 1e-9)]
            if not len(rest):
                continue
            marked[token[start[m] : start[m] + sizes[m]]] = True
            at = np.repeat(start[rest] - (np.cumsum(sizes[rest]) - sizes[rest]), sizes[rest]) + np.arange(sizes[rest].sum())
            both = np.add.reduceat(marked[token[at]].astype(np.int64), np.cumsum(sizes[rest]) - sizes[rest])
            marked[token[start[m] : start[m] + sizes[m]]] = False
            met = rest[both >= similarity * (sizes[rest] + sizes[m] - both) - 1e-9]
            root[met] = first
            queue += met.tolist()
    return root


def verified_links(sets: DataFrame, distinct: DataFrame, groups: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Links (a, b) between keys of one group whose shingle sets have the Jaccard similarity, reduced to stars.

    sets: doc_id, key, fp, grams; distinct: key, first (a doc_id that has it); groups: id (a key), root. A group's sets are dealt into blocks of about SET_BLOCK bytes, and
    every two blocks meet in one task; within it a set found similar to one member is not compared with the others.
    """
    members = groups.select(F.col("id").alias("key"), "root").unionByName(groups.select(F.col("root").alias("key"), "root").distinct())
    members = members.join(distinct.select("key", "first"), "key").withColumnRenamed("key", "__key")
    held = sets.join(members, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("first")))  # by id too: copies spread
    held = cut(held.select("root", "key", "fp", "grams").dropDuplicates(["key"]), "sets")
    blocks = held.groupBy("root").agg(F.ceil(F.sum(F.length("grams") + 200) / SET_BLOCK).alias("blocks"))
    mine = held.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "fp", "grams")

    def settle(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key)
        grams = [np.frombuffer(x, np.uint32) for x in table.column("grams").take(pa.array(order)).to_pylist()]
        root = _one_class(grams, _words(table.column("fp").combine_chunks())[order], distance, similarity)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": key[order][moved], "b": key[order][root[moved]]})

    return cells.groupBy("root", "i", "j").applyInArrow(settle, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, seed: int = 42, size: int = 1, trees: int = 0, bits: int = 13, similarity: float = 0.0) -> DataFrame:
    """doc_id, key (long), fp (binary) and component_id, the smallest id among the documents that links reach (itself included).

    Fingerprints of 64 * size bits link within `distance` bits. With trees = 0 (64 bits only) every such link is found;
    otherwise `trees` trees over `bits` random bits each find a pair that differs in a share q of the bits with a
    probability of at least 1 - (1 - (1 - q)**bits)**trees. With a similarity, fingerprints are those of the texts' sets of
    shingles, documents with equal sets are of one component, and other links need two sets of that Jaccard similarity (of
    32-bit hashes of the shingles) beside fingerprints within the distance; two sets at 0.8 differ in a share of 0.15 of the
    bits on average, so 60 of 256 bits, 40 trees and 13 bits find at least 0.99 of such links. A null text has no words, so fingerprint 0, which links like
    any other. Rows without an id take part, and name a component only where no member has an id (then null). Repeated ids
    stay rows; an empty table gives an empty table.
    """
    if not trees and size != 1:
        raise ValueError("longer fingerprints need trees")
    masks, reach = (scattered(trees, bits, size), 0) if trees else (halves(), distance // 2)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    own = cut(set_fingerprints(texts, width, size) if similarity else fingerprints(texts, width, seed, size), "fingerprints")
    distinct = cut(own.groupBy("key").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("first")), "distinct")
    roots = components(link_fingerprints(distinct, distance, masks, reach))
    if similarity:
        roots = components(verified_links(own, distinct, roots, distance, similarity))
    rooted = distinct.select("key", "first").join(roots.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    parts_n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = cut(rooted.join(smallest.repartition(parts_n), "root").select("key", "component_id"), "names")
    return own.join(names, "key").select("doc_id", "key", "fp", "component_id")

"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece BPE (B) cover the same bytes of a text.

Merging is lockstep and vectorised. The token ends of all documents of a slice lie on one byte axis; a state vector holds a
pointer into A and one into B for every lane, and each step links the two tokens under the pointers, cuts where both end at
the same byte, moves the pointers whose token ends first, and drops the lanes that are through. A long document is several
lanes, begun at ends that both tokenizers share, so that a slice takes few steps.

A pair of ids counts in how many documents it is linked. Tasks turn slices into packs: the distinct pairs of a slice, and
what each of its documents holds of them. Only the packs' distinct pairs are shuffled, summed and sent back to the packs
that asked for them; texts and tokens stay in the task.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvex.llm import bpe
from corvex.llm.common import cut, give_back, sized, text_of

SLICE = 2 << 20  # bytes of text in a pack; a longer text is a pack of its own
LANE = 128  # tokens of A in a lane, about
BLOCK = 1 << 19  # tokens of A that merge at once
SPACE = "▁"  # fixed: the sign that stands for a space in pieces
STRETCH = re.compile(" +[^ ]*")
_loaded: dict[tuple[str, str], "Pair"] = {}


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[f:f+n] for every f, n, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PieceBpe:
    """A sentencepiece BPE model that encodes each distinct stretch (spaces and what follows up to the next space) of a slice once.

    No piece has a space behind another sign, so nothing merges over a stretch's border.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:]))
        self.lone = [self.model.piece_to_id(SPACE)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the model itself puts a space before it."""
        if not self.apart:
            return [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]
        number: dict = defaultdict(count().__next__)
        parts = [STRETCH.findall(" " + t) if t else [] for t in texts]
        bounds = np.cumsum([0, *map(len, parts)])
        used = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, bounds[-1])
        ids = [x or self.lone for x in self.model.encode([s[1:] for s in number], num_threads=1)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, sizes.sum())
        n = sizes[used]
        return np.split(gather(flat, (np.cumsum(sizes) - sizes)[used], n), np.concatenate(([0], np.cumsum(n)))[bounds[1:-1]])


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a = copy.copy(bpe.load(a_path))
        self.a.at_special = None  # special tokens' strings are plain text here
        self.b = PieceBpe(b_path)
        self.a_size = np.array([len(x) for x in self.a.bytes_of], np.int64)
        self.b_size = np.array([len(x) for x in self.b.bytes_of], np.int64)
        self.signs = [[f"{i}{s}" for i in range(len(self.a.bytes_of)) for s in ",|"], [f"{i}{s}" for i in range(len(self.b.bytes_of)) for s in ",;"]]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B for space + text; none where either one's bytes are not those of space + text, or the text is empty."""
        spaced = [" " + t for t in texts]
        none = np.zeros(0, np.int32)
        out_a, out_b = [], []
        for t, s, a, b in zip(texts, spaced, self.a.encode_all(spaced), self.b.encode_all(texts), strict=True):
            raw = s.encode()
            good = t and b"".join(map(self.a.bytes_of.__getitem__, a.tolist())) == raw and b"".join(map(self.b.bytes_of.__getitem__, b.tolist())) == raw
            out_a.append(a if good else none)
            out_b.append(b if good else none)
        return out_a, out_b


def load(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Pair(a_path, b_path)
    return _loaded[a_path, b_path]


def lanes(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes begin in A and B. a_first, b_first: where each document begins, and the end of the last."""
    sizes = np.diff(a_first)
    more = np.maximum(0, (sizes - 1) // lane)
    at = np.repeat(a_first[:-1] - lane * (np.cumsum(more) - more), more) + lane * (1 + np.arange(more.sum()))
    last = np.minimum(at + lane, np.repeat(a_first[1:], more))
    found_a, found_b = [a_first[:-1][sizes > 0]], [b_first[:-1][sizes > 0]]
    while len(at):
        place = np.searchsorted(b_end, a_end[at - 1])
        shared = b_end[place] == a_end[at - 1]
        found_a.append(at[shared])
        found_b.append(place[shared] + 1)
        at, last = at[~shared] + 1, last[~shared]
        at, last = at[at < last], last[at < last]
    start_a, start_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(start_a, kind="stable")
    return start_a[order], start_b[order]


def lockstep(a_end: np.ndarray, b_end: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, stop_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (places in A, in B) and cuts (last token of a group in A, in B) of lanes that go from their start to stop_a."""
    pa_, pb, stop = start_a.copy(), start_b.copy(), stop_a
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(pa_):
        ends_a, ends_b = a_end[pa_], b_end[pb]
        links_a.append(pa_)
        links_b.append(pb)
        both = ends_a == ends_b
        cuts_a.append(pa_[both])
        cuts_b.append(pb[both])
        pa_, pb = pa_ + (ends_a <= ends_b), pb + (ends_b <= ends_a)
        going = pa_ < stop
        if not going.all():
            pa_, pb, stop = pa_[going], pb[going], stop[going]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (links_a, links_b, cuts_a, cuts_b))


class Aligned:
    """The alignment of a slice of texts. Links are summed up block by block, so that a very long text needs no more memory than its tokens."""

    def __init__(self, pair: Pair, texts: list[str], keep_links: bool = False):
        ids_a, ids_b = pair.encode(texts)
        self.n = len(texts)
        self.a_first, self.b_first = (np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int32), *ids]) for ids in (ids_a, ids_b))
        a_end, b_end = np.cumsum(pair.a_size[self.a]), np.cumsum(pair.b_size[self.b])
        doc = np.repeat(np.arange(self.n), np.diff(self.a_first))
        start_a, start_b = lanes(a_end, b_end, self.a_first, self.b_first)
        stop = np.append(start_a[1:], len(self.a))
        wide = np.int64(len(pair.b_size))
        bits = int(len(pair.a_size) * wide).bit_length()
        self.n_links = np.zeros(self.n, np.int64)
        cuts, keys, times, self.links = [], [], [], []
        for i in range(0, len(start_a), max(1, BLOCK // LANE)):
            block = slice(i, i + max(1, BLOCK // LANE))
            la, lb, ca, cb = lockstep(a_end, b_end, start_a[block], start_b[block], stop[block])
            order = np.argsort(ca)
            cuts.append((ca[order], cb[order]))
            self.n_links += np.bincount(doc[la], minlength=self.n)
            key, n = np.unique((doc[la] << bits) + self.a[la] * wide + self.b[lb], return_counts=True)
            keys.append(key)
            times.append(n)
            if keep_links:
                order = np.lexsort((lb, la))
                self.links.append((la[order], lb[order]))
        none = np.zeros(0, np.int64)
        self.cut_a, self.cut_b = (np.concatenate([none, *(c[j] for c in cuts)]) for j in (0, 1))
        self.n_groups = np.bincount(doc[self.cut_a], minlength=self.n)
        key, n = np.concatenate([none, *keys]), np.concatenate([none, *times])
        if len(keys) > 1:
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, n, len(key)).astype(np.int64)
        #: distinct pairs of the slice, in how many of its documents each is; by document: places in pairs, and how often
        self.pairs, place = np.unique(key & ((1 << bits) - 1), return_inverse=True)
        self.held_by = np.bincount(place, minlength=len(self.pairs))
        at = np.searchsorted(key >> bits, np.arange(self.n + 1))
        self.place, self.times, self.at = place.astype(np.int32), n.astype(np.int32), at

    def groups(self, pair: Pair) -> Iterator[str]:
        """Each document's groups, written `a1,a2|b1;a3|b2,b3`."""
        group_a = np.searchsorted(self.cut_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.cut_b, np.arange(len(self.b)))
        out = np.zeros(len(self.a) + len(self.b), np.int64)  # two entries a token in signs: with the sign within, and the one behind a side
        shift = 2 * len(pair.a_size)
        out[np.arange(len(self.a)) + np.concatenate(([0], self.cut_b + 1))[group_a]] = 2 * self.a + np.isin(np.arange(len(self.a)), self.cut_a, assume_unique=True)
        out[np.arange(len(self.b)) + (self.cut_a + 1)[group_b]] = shift + 2 * self.b + np.isin(np.arange(len(self.b)), self.cut_b, assume_unique=True)
        names = [*pair.signs[0], *pair.signs[1]]
        first = self.a_first + self.b_first
        for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
            yield "".join(map(names.__getitem__, out[s:e].tolist()))[:-1]


def align_documents(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """docs with a_ids, b_ids, groups (`a1,a2|b1;a3|b2,b3`), link_a and link_b (token numbers of A and B that overlap, in order).

    These replace columns of the same names. Null, empty and unalignable texts have no tokens, no links and empty groups.
    """
    ints = T.ArrayType(T.IntegerType())
    added = {"a_ids": ints, "b_ids": ints, "groups": T.StringType(), "link_a": ints, "link_b": ints}

    def make(texts: list[str]) -> dict:
        pair = load(a_path, b_path)
        found = Aligned(pair, texts, keep_links=True)
        la, lb = (np.concatenate([np.zeros(0, np.int64), *(x[j] for x in found.links)]) for j in (0, 1))
        inner = np.searchsorted(la, found.a_first)
        by_doc = lambda values, first, base: [values[s:e] - o for s, e, o in zip(first[:-1], first[1:], base)]
        zero = np.zeros(found.n, np.int64)
        return {
            "a_ids": by_doc(found.a, found.a_first, zero), "b_ids": by_doc(found.b, found.b_first, zero), "groups": list(found.groups(pair)),
            "link_a": by_doc(la, inner, found.a_first), "link_b": by_doc(lb, inner, found.b_first),
        }

    return bpe._mapped(docs.withColumn(text_col, text_of(text_col)), text_col, added, make)


def _packs(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (pack, id, counts, digest, places in the pack's pairs, times) and, for each pack, one row of its pairs and in how many documents each is."""
    ints = T.ArrayType(T.IntegerType())
    fields = [(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", T.StringType()), ("place", ints), ("times", ints), ("pairs", T.ArrayType(T.LongType())), ("held_by", ints)]
    schema = T.StructType([T.StructField("pack", T.LongType()), T.StructField("is_doc", T.BooleanType()), T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in sized(batch, "t", SLICE):
                pair, number = load(a_path, b_path), next(numbers)
                x = Aligned(pair, part.column(1).to_pylist())
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups(pair)]
                lists = lambda values: pa.ListArray.from_arrays(pa.array(x.at, pa.int32()), pa.array(values, pa.int32()))
                nulls = lambda kind: pa.nulls(x.n, kind)
                own = [pa.array([number] * x.n, pa.int64()), pa.array([True] * x.n), part.column(0).cast(arrow.field("id").type), *(pa.array(v, pa.int64()) for v in (np.diff(x.a_first), np.diff(x.b_first), x.n_groups, x.n_links)), pa.array(digest), lists(x.place), lists(x.times)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(own, arrow)] + [nulls(f.type) for f in list(arrow)[len(own) :]], schema=arrow)
                if len(x.pairs):
                    row = {"pack": number, "is_doc": False, "pairs": x.pairs, "held_by": x.held_by.astype(np.int32)}
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)
        give_back()

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).mapInArrow(run, schema)


def pair_counts(packs: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): in how many documents each pair of ids (a * n_b + b) is linked, and whether no pair of the same a is in more."""
    asked = packs.where("NOT is_doc").select(F.explode(F.arrays_zip("pairs", "held_by")).alias("x"))
    counts = asked.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held_by").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.expr(f"pair DIV {n_b}")))  # at most n_b rows each
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts links whose pair is in as many documents as any pair of its A id (ties included); count_sum adds the pairs'
    counts over links. Null, empty and unalignable texts have zeros and the digest ''. Repeated rows and null ids are
    documents of their own; other columns are left out; an empty table gives an empty table.
    """
    packs = cut(_packs(docs, a_path, b_path, id_col, text_col), "packs")
    n_b = len(load(a_path, b_path).b_size)
    asked = packs.where("NOT is_doc").select(F.col("pack").alias("to"), F.posexplode("pairs").alias("position", "pair"))
    answers = asked.join(pair_counts(packs, n_b), "pair").select("to", "position", "count", "best")
    own = packs.where("is_doc").drop("is_doc", "pairs", "held_by")
    kept = [f for f in own.schema if f.name not in ("pack", "place", "times", "groups_sha256")]
    out = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), own.schema["groups_sha256"]])
    arrow = to_arrow_schema(out)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        order = np.argsort(right.column("position").to_numpy())
        n, best = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        lists = left.column("place").combine_chunks()
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        place, times = lists.flatten().to_numpy(), left.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        total = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[at])
        found = {"n_best": total(times * best[place]) if len(place) else np.zeros(left.num_rows, np.int64), "count_sum": total(times * n[place]) if len(place) else np.zeros(left.num_rows, np.int64)}
        return pa.table([pa.array(found[f.name], f.type) if f.name in found else left.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    joined = own.groupBy("pack").cogroup(answers.groupBy("to")).applyInArrow(one, out)
    return joined.withColumnRenamed("id", id_col)

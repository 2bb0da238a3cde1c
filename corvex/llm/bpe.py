"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands inside no vocabulary token can never be merged over, so every such pair in a text is a
certain cut. A text is cut at special tokens, then by the pre-tokenizer's pattern, then at the forced boundaries; the
fragments are encoded independently and their ids concatenated. Work is per row: no shuffle at all.

A task reads texts in slices of bounded size. No pre-token holds white space but at its start, so a text may also be cut
before every white space that follows another sign; the distinct stretches of a slice are pre-tokenized once, and their
fragments merge side by side, as the rows of a matrix. Nothing is kept from slice to slice.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvex.llm.common import give_back, sized, text_of, with_columns
from corvex.llm.unicode_classes import LETTER, NUMBER, class_table, ranges_of

# Unicode white space; the published pre-tokenizer pattern of byte-level BPE.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 2 << 20  # bytes of text read at once
WIDTHS, NEVER = (4, 8, 16, 32, 64), np.int32(1 << 30)  # columns of the matrices; the rank of a pair that does not merge
BETWEEN = re.compile(f"([{SPACE}]{{2,}})")
_loaded: dict[str, "ByteBpe"] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def merge_bytes(symbols: list, ranks: dict) -> list:
    """Merge neighbours, lowest rank first and leftmost among equals, until no pair has a rank."""
    if len(symbols) < 24:
        symbols = list(symbols)
        while len(symbols) > 1:
            best, where = None, -1
            for i, pair in enumerate(zip(symbols, symbols[1:])):
                r = ranks.get(pair)
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        return symbols
    n = len(symbols)
    right, left, part = [*range(1, n), -1], [-1, *range(n - 1)], list(symbols)
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(part, part[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, (a, b) = heapq.heappop(heap)
        j = right[i]
        if part[i] != a or j < 0 or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (r := ranks.get((part[x], part[y]))) is not None:
                heapq.heappush(heap, (r, x, (part[x], part[y])))
    return [p for p in part if p is not None]


class ByteBpe:
    def __init__(self, path: str):
        file = json.load(open(path, encoding="utf-8"))
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda token: bytes(back[c] for c in token)
        self.ids = {raw(t): i for t, i in file["model"]["vocab"].items()}
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(file["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(*self.ids.values(), *self.special.values()))
        for token, i in chain(self.ids.items(), ((t.encode(), i) for t, i in self.special.items())):
            self.bytes_of[i] = token
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.joined = np.zeros((256, 256), bool)
        for t in self.ids:
            for a, b in zip(t, t[1:]):
                self.joined[a, b] = True
        plain = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pattern = regex.compile(plain)
        # the library's letters and numbers are not those of the regex module: texts with a code point that differs take the exact pattern
        letters, numbers = ranges_of(LETTER), ranges_of(NUMBER)
        self.exact = regex.compile(plain.replace(r"\s\p{L}\p{N}]", rf"\s{letters}{numbers}]").replace(r"\p{L}\p{N}]", f"{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        self.differs = np.zeros(0x110000, bool)
        for kind, own in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            theirs = np.zeros(0x110000, bool)
            theirs[np.frombuffer("".join(regex.findall(own, every)).encode("utf-32-le"), np.uint32)] = True
            self.differs |= theirs != (class_table() == kind)
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # ranks of merges by pair of ids, in a table with open addressing; the id of the merged token by rank
        self.pairs = np.array([self.ids[a] * len(self.bytes_of) + self.ids[b] for a, b in self.ranks], np.uint64)
        self.shift = np.uint64(64 - max(8, 16 * len(self.pairs)).bit_length())
        table = [-1] * (1 << (64 - int(self.shift)))
        for rank, place in enumerate(self._place(self.pairs).tolist()):
            while table[place] >= 0:
                place = (place + 1) % len(table)
            table[place] = rank
        self.table = np.array(table, np.int32)
        self.merged = np.array([self.ids[a + b] for a, b in self.ranks], np.int32)
        self.edges = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)

    def _place(self, pair: np.ndarray) -> np.ndarray:
        return (pair * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def pre_tokens(self, text: str) -> list[str]:
        rare = not text.isascii() and self.differs[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()
        return (self.exact if rare else self.pattern).findall(text)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER where they do not merge or one is no token (-1)."""
        pair = (left.astype(np.int64) * len(self.bytes_of) + right).astype(np.uint64)
        place = self._place(pair)
        rank = self.table[place]
        other = np.nonzero((rank >= 0) & (self.pairs[rank] != pair))
        while len(other[0]):
            place[other] = (place[other] + np.uint64(1)) & np.uint64(len(self.table) - 1)
            rank[other] = self.table[place[other]]
            other = tuple(x[(rank[other] >= 0) & (self.pairs[rank[other]] != pair[other])] for x in other)
        return np.where((rank >= 0) & (left >= 0) & (right >= 0), rank, NEVER)

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Each row's ids (-1 behind its end) after all merges: in every round each row merges its pair of lowest rank, the leftmost of equals."""
        done, where = np.full_like(rows, -1), np.arange(len(rows))
        rank = self.pair_ranks(rows[:, :-1], rows[:, 1:])
        columns = np.arange(rows.shape[1])
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            open_ = best < NEVER
            done[where[~open_]] = rows[~open_]
            where, rows, rank, at, best = where[open_], rows[open_], rank[open_], at[open_], best[open_]
            each = np.arange(len(rows))
            take = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            rows = np.take_along_axis(rows, take, 1)
            rows[:, -1] = -1
            rows[each, at] = self.merged[best]
            rank = np.take_along_axis(rank, np.minimum(take[:, :-1], len(columns) - 2), 1)
            rank[:, -1] = NEVER
            rank[each, np.minimum(at, len(columns) - 2)] = self.pair_ranks(rows[each, at], rows[each, np.minimum(at + 1, len(columns) - 1)])
            after = at > 0
            rank[each[after], at[after] - 1] = self.pair_ranks(rows[each[after], at[after] - 1], rows[each[after], at[after]])
        return done

    def cuts(self, body: np.ndarray) -> np.ndarray:
        """Whether a forced boundary lies before each byte of body."""
        return np.concatenate(([True], ~self.joined[body[:-1], body[1:]])) if len(body) else np.zeros(0, bool)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has."""
        text = "".join(pieces)
        body = np.frombuffer(text.encode(), np.uint8)
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if len(body) > len(text):
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            size = np.concatenate(([0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))))
            sizes = np.diff(size[np.concatenate(([0], np.cumsum(sizes)))])
        first = np.cumsum(sizes) - sizes
        cut = self.cuts(body)
        cut[first] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(body)))
        out = np.full(len(body), -1, np.int32)  # a fragment's ids stand from its first byte on
        single = starts[lengths == 1]
        out[single] = self.single[body[single]]
        for low, width in zip((1, *WIDTHS), WIDTHS):
            mine = np.flatnonzero((lengths > low) & (lengths <= width))
            if len(mine):
                place = starts[mine, None] + np.arange(width)
                inside = np.arange(width) < lengths[mine, None]
                rows = self.merge_rows(np.where(inside, self.single[body[np.where(inside, place, 0)]], -1))
                out[place[inside]] = rows[inside]
        for i in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            raw = body[starts[i] : starts[i] + lengths[i]].tobytes()
            ids = [self.ids[x] for x in merge_bytes([raw[j : j + 1] for j in range(len(raw))], self.ranks)]
            out[starts[i] : starts[i] + len(ids)] = ids
        has = out >= 0
        return out[has], np.add.reduceat(has.astype(np.int64), first)

    def stretches(self, text: str) -> list[str | tuple]:
        """The stretches of a text: words without the space before them (with the newline, if that comes before them); in a tuple, others as they are, and ids of special tokens."""
        parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
        out: list = []
        for number, part in enumerate(parts):
            if number % 2:
                out.append((self.special[part],))
                continue
            head, blocks = "", BETWEEN.split(part)
            for i, block in enumerate(blocks):
                if i % 2:  # of a run of white space the last sign starts what follows
                    follows = bool(blocks[i + 1])
                    out.append((block[:-1] if follows else block,))
                    head = block[-1] if follows else ""
                elif block:
                    first, *rest = (head + block).replace("\n", " \n").split(" ")
                    if first:
                        out.append((first,))
                    out += rest
                    if rest and block[-1:] in self.edges:  # a last sign of white space: whole with what it follows
                        out[-1] = (rest[-1] if rest[-1][:1] == "\n" else " " + rest[-1],)
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        number: dict = defaultdict(count().__next__)
        parts = list(map(self.stretches, texts))
        bounds = np.cumsum([0, *map(len, parts)])
        used = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, bounds[-1])
        words = [i for i, s in enumerate(number) if type(s) is str]
        own = [s if s[:1] == "\n" else " " + s for s in number if type(s) is str]
        pieces = self.pre_tokens("".join(own))
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        begins = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        holder = [np.array(words, np.int64)[np.searchsorted(ends, begins, "left")]]
        tokens = []
        for i, s in enumerate(number):
            if type(s) is tuple:
                if isinstance(s[0], int):
                    tokens.append((i, s[0]))
                else:
                    found = self.pre_tokens(s[0])
                    pieces += found
                    holder.append(np.full(len(found), i))
        ids, sizes = self.encode_pieces(pieces)
        owner = np.concatenate([np.repeat(np.concatenate(holder), sizes), np.array([i for i, _ in tokens], np.int64)])
        ids = np.concatenate([ids, np.array([t for _, t in tokens], np.int32)])[np.argsort(owner, kind="stable")]
        counts = np.bincount(owner, minlength=len(number))
        first = np.cumsum(counts) - counts
        n = counts[used]
        ends = np.cumsum(n)
        flat = ids[np.repeat(first[used] - (ends - n), n) + np.arange(n.sum())]
        return np.split(flat, np.concatenate(([0], ends))[bounds[1:-1]])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _mapped(docs: DataFrame, text_col: str, added: dict[str, T.DataType], make, drop: tuple[str, ...] = ()) -> DataFrame:
    fields = [docs.schema[c] for c in docs.columns if c not in added and c not in drop]
    out = T.StructType([*fields, *(T.StructField(n, t) for n, t in added.items())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, text_col, SLICE):
                column = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield with_columns(part, arrow, **make(column))
        give_back()

    return docs.mapInArrow(run, out)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with their token ids (array<int>), n_tokens, and round_trip, whether decoding the ids gives the text again.

    These replace columns of the same names. A null text has no tokens. Equals the library's encode without added special tokens.
    """

    def make(texts: list[str]) -> dict:
        model = load(path)
        ids = model.encode_all(texts)
        return {out_col: ids, "n_tokens": [len(x) for x in ids], "round_trip": [model.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]}

    ready = docs.withColumn(text_col, text_of(text_col))
    return _mapped(ready, text_col, {out_col: T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "round_trip": T.BooleanType()}, make)


def decode_documents(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the text that their ids stand for; null ids give the empty text. Bytes that are no UTF-8 become U+FFFD."""
    return _mapped(docs, ids_col, {out_col: T.StringType()}, lambda ids: {out_col: [load(path).decode(x or []) for x in ids]})


def digest_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and the SHA-256 digests of the ids (decimal, joined by commas) and of the decoded text, which
    replace columns of these names, in one pass that moves neither out of the task.

    A null or empty text has no tokens and the digests of the empty string. Repeated rows and null ids stay rows; an
    empty table gives an empty table.
    """

    def make(texts: list[str]) -> dict:
        model = load(path)
        n, ids_hash, text_hash = [], [], []
        for ids in map(np.ndarray.tolist, model.encode_all(texts)):
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(model.names.__getitem__, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    ready = docs.withColumn(text_col, text_of(text_col))
    return _mapped(ready, text_col, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, make)

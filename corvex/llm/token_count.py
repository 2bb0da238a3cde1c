"""Token counts by finite-state transducers.

Two deterministic transducers are used. The piece transducer reads character classes and marks where a pre-token starts;
a text is cut into chunks, every chunk's map from entry state to exit state is built for all states at once, and the maps
compose through a parallel prefix scan, so each chunk is then read from its true state. The word transducer reads the
symbols of a pre-token; its transitions carry the number of tokens that become certain there. Its states hold, for every
place where an open token may have started, the last token before that place and how many tokens lie behind; they are
compiled on first use. Both come from the vocabulary file alone. Work is per row: no shuffle at all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvex.llm import unicode_classes
from corvex.llm.bpe import SPACE, byte_alphabet, merge_bytes
from corvex.llm.common import give_back, sized, text_of, with_columns

CHUNK, CACHE = 64, 400_000
S, N, L, STMD, RV, LL, E, QUOTE, OTHER = range(9)  # character classes
START, LETTERS, NUMBER, SIGNS, APOS, APOS_RV, APOS_L, SHORT = range(8)  # states
HERE, BEFORE = 1, 2  # a piece starts at this character, at the one before
_loaded: dict[str, "Counter"] = {}


def piece_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by state and class, for letters, single digits, other signs and the short forms ('s 't 'm 'd 're 've 'll)."""
    step, out = np.zeros((8, 9), np.uint8), np.zeros((8, 9), np.uint8)
    letter = (L, STMD, RV, LL, E)
    fresh = {S: (START, 0), N: (NUMBER, HERE), QUOTE: (APOS, HERE), OTHER: (SIGNS, HERE)} | dict.fromkeys(letter, (LETTERS, HERE))
    table = {s: dict(fresh) for s in (START, LETTERS, NUMBER, SIGNS, APOS, SHORT)}
    table[LETTERS] |= dict.fromkeys(letter, (LETTERS, 0))
    table[SIGNS] |= {QUOTE: (SIGNS, 0), OTHER: (SIGNS, 0)}
    table[APOS] |= {QUOTE: (SIGNS, 0), OTHER: (SIGNS, 0), STMD: (SHORT, 0), RV: (APOS_RV, 0), LL: (APOS_L, 0)}
    for state, ends in ((APOS_RV, E), (APOS_L, LL)):  # no short form: a letter piece started at the character before
        table[state] = {c: (s, o | BEFORE) for c, (s, o) in fresh.items()} | dict.fromkeys(letter, (LETTERS, BEFORE)) | {ends: (SHORT, 0)}
    for state, row in table.items():
        for c, (s, o) in row.items():
            step[state, c], out[state, c] = s, o
    return step, out


def class_table() -> np.ndarray:
    table = np.array([OTHER, L, N], np.uint8)[unicode_classes.class_table()]
    for found in regex.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))):
        table[ord(found)] = S
    for chars, kind in (("stmd", STMD), ("rv", RV), ("l", LL), ("e", E), ("'", QUOTE)):
        table[[ord(c) for c in chars]] = kind
    return table


class WordTransducer:
    """Counts the tokens that BPE makes of a piece whose last symbol carries the end-of-word mark."""

    def __init__(self, vocab: set[str], ranks: dict[tuple[str, str], int], suffix: str):
        self.vocab, self.ranks, self.suffix = vocab, ranks, suffix
        self.symbols = {t: self._split(t) for t in vocab}
        self.prefixes = {tuple(s[:i]) for s in self.symbols.values() for i in range(1, len(s))}
        self.whole: dict[tuple[str, ...], str] = {tuple(s): t for t, s in self.symbols.items()}
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states = [((), ((0, None, 0),))]  # open symbols; places: offset, last token before it, tokens behind it
        self.number = {self.states[0]: 0}
        self.arcs: dict[tuple[int, str], tuple[int, int]] = {}

    def _split(self, token: str) -> list[str]:
        if not token.endswith(self.suffix):
            return list(token)
        token = token.removesuffix(self.suffix)
        return [*token[:-1], token[-1:] + self.suffix]

    def fit(self, before: str | None, token: str) -> bool:
        """Whether BPE of the two tokens' symbols gives these two tokens again; of two neighbours in any encoding this holds."""
        got = self.fits.get((before, token))
        if got is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            own = [*(self.symbols[before] if before else []), *self.symbols[token]]
            got = self.fits[before, token] = merge_bytes(own, self.ranks) == ([before, token] if before else [token])
        return got

    def arc(self, state: int, symbol: str) -> tuple[int, int]:
        got = self.arcs.get((state, symbol))
        if got is not None:
            return got
        opened, places = self.states[state]
        opened = (*opened, symbol)
        last = count = None
        for offset, before, behind in places:
            token = self.whole.get(opened[offset:])
            if token is not None and self.fit(before, token):
                last, count = token, behind + 1
                break
        if count is None:
            raise ValueError(f"no token covers {symbol!r}")
        if symbol.endswith(self.suffix) and len(symbol) > 1:
            got = (0, count)  # the piece ends: all that was open is certain
        else:
            places = [p for p in places if opened[p[0] :] in self.prefixes] + [(len(opened), last, count)]
            first, least = places[0][0], min(p[2] for p in places)
            key = (opened[first:], tuple((o - first, t, c - least) for o, t, c in places))
            if key not in self.number:
                self.number[key] = len(self.states)
                self.states.append(key)
            got = (self.number[key], least)
        self.arcs[state, symbol] = got
        return got

    def count(self, symbols: list[str]) -> int:
        if len(self.arcs) > 4 * CACHE:
            self.clear()
        state = total = 0
        for symbol in symbols:
            state, emitted = self.arc(state, symbol)
            total += emitted
        return total


class Counter:
    def __init__(self, path: str):
        file = json.load(open(path, encoding="utf-8"))
        model = file["model"]
        self.word = WordTransducer(set(model["vocab"]), {tuple(m): r for r, m in enumerate(model["merges"])}, model["end_of_word_suffix"])
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.first = special[0][:2]
        self.bytes = [byte_alphabet()[b] for b in range(256)]
        self.step, self.out = piece_transducer()
        self.classes = class_table()
        self.known: dict[str, int] = {}

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and where a piece or white space starts: chunk maps for all entry states, their prefix scan, then one pass from the true states."""
        kinds = self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        n = len(kinds)
        rows = -(-(n + 1) // CHUNK)
        grid = np.full(rows * CHUNK, S, np.uint8)  # the text ends as if by a space
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        flat_step, flat_out = self.step.ravel(), self.out.ravel()
        maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
        if rows > 1:
            for column in grid:
                maps = flat_step[maps * np.uint8(9) + column[:, None]]
            gap = 1
            while gap < rows:  # inclusive scan: maps[i] becomes the map of all chunks up to i
                maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].copy(), 1)
                gap *= 2
        state = np.zeros(rows, np.uint8)
        state[1:] = maps[:-1, START]
        marks = np.empty((CHUNK, rows), np.uint8)
        for i, column in enumerate(grid):
            at = state * np.uint8(9) + column
            marks[i] = flat_out[at]
            state = flat_step[at]
        marks = marks.T.ravel()[: n + 1]
        begins = (marks[:n] & HERE).astype(bool)
        begins |= (marks[1:] & BEFORE).astype(bool)
        return np.flatnonzero(begins), np.flatnonzero(begins | (kinds == S))

    def piece(self, piece: str) -> int:
        got = self.known.get(piece)
        if got is None:
            symbols = [self.bytes[b] for b in piece.encode()]
            symbols[-1] += self.word.suffix
            got = self.word.count(symbols)
            if len(self.known) > CACHE:
                self.known.clear()
            if len(piece) < 200:
                self.known[piece] = got
        return got

    def plain(self, texts: list[str]) -> list[int]:
        """Token counts of several texts without special tokens; a space between two texts keeps their pieces apart."""
        ready = []
        for t in texts:
            ready.append(t.lower() if t.isascii() else unicode_classes.lower(unicode_classes.compose(t)))
        whole = " ".join(ready)
        begins, stops = self.starts(whole)
        after = np.append(stops, len(whole))
        ends = after[np.searchsorted(stops, begins, "right")]
        known, piece = self.known, self.piece
        counts = [known.get(p) or piece(p) for p in map(whole.__getitem__, map(slice, begins.tolist(), ends.tolist()))]
        sums = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        sizes = np.cumsum([len(t) + 1 for t in ready])
        at = np.searchsorted(begins, np.concatenate(([0], sizes)))
        return np.diff(sums[at]).tolist()

    def count(self, texts: list[str]) -> list[int]:
        parts, owner, extra = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            split = self.special.split(t) if self.first in t else [t]
            extra[i] = len(split) - 1
            parts += split
            owner += [i] * len(split)
        out = np.array(extra, np.int64)
        np.add.at(out, owner, self.plain(parts))
        return out.tolist()


def load(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), which replace columns of these names.

    Counts equal the library's for the vocabulary at path, without added special tokens; special strings inside a text
    count as one token. A null or empty text has no bytes and no tokens. Repeated rows and null ids stay rows; an empty table
    gives an empty table.
    """
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    ready = docs.withColumn(text_col, text_of(text_col))
    out = T.StructType([*(ready.schema[c] for c in docs.columns if c not in added), *(T.StructField(n, t) for n, t in added.items())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for part in sized(batch, text_col):
                column = part.column(part.schema.get_field_index(text_col))
                texts = column.to_pylist()
                n = counter.count(texts)
                yield with_columns(part, arrow, n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=[x > limit for x in n])
        give_back()

    return ready.mapInArrow(run, out)

"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The nodes of a document's field are its tokens with a digit or an at sign. Each has a unary potential from its shape and
context, neighbouring nodes share a chain potential, and nodes with the same or a similar key (distant repeats) share a
skip potential that rewards equal labels. The potentials are log ratios of counts, taken over the whole corpus with the
patterns' finds as labels. Loopy belief propagation runs over all documents of a batch at once; a token that the patterns
left alone and whose belief in a kind passes a threshold becomes a further span. The patterns' spans always stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvex.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
BUCKETS, LABELS = 4096, len(KINDS) + 1
# The patterns of the kinds. The look-behinds only skip starts from which no match can begin.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")
NODE = re.compile(r"[0-9@]")
EDGES = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards, so long words without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _shape(token: str) -> str:
    out = []
    for c in token[:64]:
        kind = "0" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != kind or kind not in "a0":
            out.append(kind)
    return "".join(out)


class Nodes:
    """The nodes of one batch of documents: place, label by the patterns, features, chain and skip links."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.spans: list[tuple[int, int]] = []
        self.labels: list[int] = []
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, number: int, text: str, base: list[tuple[int, int, int]]) -> None:
        last_token, last_node, before, seen = -2, -1, "", {}
        by_start = sorted((a, b, k) for k, a, b in base)
        nth = 0
        waiting: list[int] | None = None
        for i, m in enumerate(TOKEN.finditer(text)):
            token = m[0]
            if waiting is not None:
                waiting.append(self._bucket("n", token.strip(EDGES).lower()[:12]))
                waiting = None
            if NODE.search(token):
                core = token.strip(EDGES)
                start = m.start() + token.find(core) if core else m.start()
                end = start + len(core) if core else m.end()
                while nth < len(by_start) and by_start[nth][1] <= start:
                    nth += 1
                label = next((k + 1 for a, b, k in by_start[nth : nth + 4] if a < end and b > start), 0)
                digits = sum("0" <= c <= "9" for c in core)
                waiting = [self._bucket("s", _shape(core)), self._bucket("d", f"{digits} {'@' in core}"), self._bucket("l", str(min(len(core), 40))), self._bucket("p", before)]
                node = len(self.doc)
                self.doc.append(number)
                self.spans.append((start, end))
                self.labels.append(label)
                self.features.append(waiting)
                if last_token == i - 1:
                    self.chain.append((last_node, node))
                for key in self._keys(core):
                    if key in seen and seen[key] != node:
                        self.skip.append((seen[key], node))
                    seen[key] = node
                last_token, last_node = i, node
            before = token.strip(EDGES).lower()[:12]
        if waiting is not None:
            waiting.append(self._bucket("n", ""))

    @staticmethod
    def _keys(core: str) -> list[str]:
        """Equal tokens share their text, similar ones their digits (seven or more) or the part before the at sign."""
        digits = "".join(c for c in core if "0" <= c <= "9")
        keys = ["t" + core.lower()]
        if len(digits) >= 7:
            keys.append("d" + digits[-10:])
        if "@" in core:
            keys.append("m" + core.lower().partition("@")[0])
        return keys

    @staticmethod
    def _bucket(kind: str, value: str) -> int:
        return xxhash.xxh3_64_intdigest(f"{kind} {value}") % BUCKETS


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int]]], Nodes]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            nodes, base = Nodes(), []
            for number, text in enumerate(part.column(1).to_pylist()):
                base.append(base_spans(text))
                if NODE.search(text):
                    nodes.add(number, text, base[-1])
            yield part, base, nodes


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Potentials from counts over all of docs (doc_id, text): at most BUCKETS * LABELS + 2 * LABELS**2 rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for _, _, nodes in _batches(batches):
            for label, features in zip(nodes.labels, nodes.features, strict=True):
                tally["y", 0, label] += 1
                for f in features:
                    tally["f", f, label] += 1
            for kind, links in (("c", nodes.chain), ("k", nodes.skip)):
                for a, b in links:
                    tally[kind, nodes.labels[a], nodes.labels[b]] += 1
        yield pa.RecordBatch.from_pylist([{"kind": k, "x": x, "y": y, "n": n} for (k, x, y), n in tally.items()], schema=pa.schema([("kind", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())]))

    counts = {"y": np.full((1, LABELS), 1.0), "f": np.full((BUCKETS, LABELS), 0.0), "c": np.full((LABELS, LABELS), 0.5), "k": np.full((LABELS, LABELS), 0.5)}
    for r in docs.mapInArrow(count, "kind string, x long, y long, n long").groupBy("kind", "x", "y").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"]][r["x"], r["y"]] += r["n"]
    prior = counts["y"][0] / counts["y"].sum()
    smooth = counts["f"] + 2 * prior
    unary = np.log(smooth / smooth.sum(1, keepdims=True)) - np.log(prior)  # log P(label | feature) / P(label)
    links = {}
    for kind in "ck":
        both = counts[kind] + counts[kind].T
        both /= both.sum()
        links[kind] = np.log(both) - np.log(both.sum(1))[:, None] - np.log(both.sum(0))[None]
    return {"prior": np.log(prior), "unary": unary, "chain": links["c"], "skip": np.maximum(links["k"], np.eye(LABELS) - 0.5)}


def beliefs(nodes: Nodes, model: dict[str, np.ndarray], rounds: int = 10, weight: float = 0.5) -> np.ndarray:
    """Marginals of every node by loopy belief propagation over chain and skip links together."""
    n = len(nodes.doc)
    own = np.zeros((n, LABELS))
    at = np.repeat(np.arange(n), [len(f) for f in nodes.features])
    np.add.at(own, at, model["unary"][[f for x in nodes.features for f in x]])
    own = weight * own + model["prior"]
    links = np.array(nodes.chain + nodes.skip, np.int64).reshape(-1, 2)
    total = own
    if len(links):
        table = np.concatenate([np.repeat(model["chain"][None], len(nodes.chain), 0), np.repeat(model["skip"][None], len(nodes.skip), 0)])
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        message = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            total = own.copy()
            np.add.at(total, target, message)
            cavity = total[source] - message[back]
            new = np.logaddexp.reduce(cavity[:, :, None] + table, axis=1)
            new -= np.logaddexp.reduce(new, axis=1)[:, None]
            message = 0.5 * message + 0.5 * new
        total = own.copy()
        np.add.at(total, target, message)
    return np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])



def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.95) -> DataFrame:
    """doc_id, base_spans and spans: arrays of (kind, start, end) in code points, by kind (email, ip, card, phone), then start.

    base_spans are the patterns' finds, spans these and the field's. A null text has none. Ids may be null or repeated.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(own))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, base, nodes in _batches(batches):
            spans = [list(b) for b in base]
            if nodes.doc:
                belief = beliefs(nodes, model.value)
                label = belief[:, 1:].argmax(1)
                sure = belief[np.arange(len(label)), label + 1] >= threshold
                for i in np.flatnonzero(sure):
                    (start, end), number = nodes.spans[i], nodes.doc[i]
                    if all(b <= start or a >= end for _, a, b in base[number]):
                        spans[number].append((int(label[i]), start, end))
            shown = lambda rows: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(r)] for r in rows], arrow_span)
            yield pa.RecordBatch.from_arrays([part.column(0), shown(base), shown(spans)], ["doc_id", "base_spans", "spans"])

    return own.mapInArrow(run, T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("base_spans", span), T.StructField("spans", span)]))

"""Removal of repeated byte strings by suffix sorting (deep-shallow).

Suffixes that can share a string of WIDTH bytes are brought together by anchors: the leftmost smallest K-gram hash among
the K-grams of each WIDTH-byte window stands at the same offset in every copy of the window. Packs ask shards which anchor
hashes other packs hold too; only the windows of repeated anchors travel, as stretches of text around the anchor, equal
stretches of a pack once. A shard sorts the suffixes (windows) of its distinct stretches: multikey quicksort on 8-byte
symbols down to SHALLOW bytes, then blind tries for the groups that still tie. Equal windows share the smallest document,
and a document loses the windows that a smaller one holds. The hash only selects what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvex.llm.packs import build_packs, bundles, by_shard, runs, shard_count, squeeze, texts_of, unsqueeze
from corvex.llm.vec import U, prefix_sums, span_hashes

WIDTH, K, SHALLOW, PACK_BYTES = 50, 18, 16, 4 << 20
STEPS = WIDTH - K + 1  # K-grams of a window
KEY_BITS = ~U(0xFFFF)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, key) of each anchor: the windows that choose it, as byte offsets in the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    body = np.frombuffer(b"".join(texts), np.uint8)
    n = len(body) - WIDTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    at = np.arange(len(body) - K + 1)
    gram = span_hashes(prefix_sums(body), at, at + K)
    low, where, span = gram, at.astype(np.int32), 1
    for step in (1, 2, 4, 8, 16, 1):  # smallest of 2, 4, 8, 16, 32, then 33 K-grams, the leftmost of equals
        left = low[:-step] <= low[step:]
        low, where, span = np.where(left, low[:-step], low[step:]), np.where(left, where[:-step], where[step:]), span + step
    assert span == STEPS
    where = where[:n]
    inside = np.zeros(n + 1, bool)
    for a, size in zip(starts[sizes >= WIDTH].tolist(), sizes[sizes >= WIDTH].tolist()):
        inside[a : a + size - WIDTH + 1] = True
    window = np.flatnonzero(inside[:n])
    if not len(window):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    text = np.searchsorted(starts[sizes >= WIDTH], window, "right") - 1
    text = np.flatnonzero(sizes >= WIDTH)[text]
    chosen = where[window]
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(first[1:], len(window)) - 1
    return text[first], window[first] - starts[text[first]], window[last] - starts[text[last]], gram[chosen[first]] & KEY_BITS


def _leading_equal_bytes(x: np.ndarray) -> np.ndarray:
    return sum((x < U(1 << (56 - 8 * i))).astype(np.int64) for i in range(7)) + (x == 0)


def sort_windows(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A label for each window body[a : a + WIDTH], equal for equal windows, by deep-shallow sorting; -1 for windows without an equal."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)]).astype(U)
    word = np.zeros(len(body) + 1, U)
    for i in range(8):
        word |= padded[i : i + len(body) + 1] << U(56 - 8 * i)
    label = np.full(len(at), -1, np.int64)
    # shallow: multikey quicksort; at each depth only suffixes that tie so far are sorted on
    member, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, SHALLOW, 8):
        symbol = word[at[member] + depth]
        order = np.lexsort((symbol, group))
        member, group, symbol = member[order], group[order], symbol[order]
        member, group = _ties(member, (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1]))
    # deep: a blind trie for each group that ties; it keeps only where members part from its first one, and what stands there
    tail = U(0xFFFFFFFFFFFFFFFF) << U(64 - 8 * ((WIDTH - SHALLOW) % 8 or 8))
    depths = list(range(SHALLOW, WIDTH, 8))
    while len(member):
        leaders = member[np.concatenate(([True], group[1:] != group[:-1]))]
        leader = leaders[np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))]
        parted = np.full(len(member), WIDTH)
        byte = np.zeros(len(member), np.int64)
        open_ = np.ones(len(member), bool)
        for depth in depths:
            mine = word[at[member] + depth]
            diff = mine ^ word[at[leader] + depth]
            if depth == depths[-1]:
                diff &= tail
            here = open_ & (diff != 0)
            equal = _leading_equal_bytes(diff[here])
            parted[here] = depth + equal
            byte[here] = ((mine[here] >> (U(56) - U(8) * equal.astype(U))) & U(255)).astype(np.int64)
            open_ &= ~here
        label[member[open_]] = leader[open_]
        member, group, parted, byte = member[~open_], group[~open_], parted[~open_], byte[~open_]
        order = np.lexsort((byte, parted, group))
        member, group, parted, byte = member[order], group[order], parted[order], byte[order]
        member, group = _ties(member, (group[1:] != group[:-1]) | (parted[1:] != parted[:-1]) | (byte[1:] != byte[:-1]))
    size = np.bincount(label[label >= 0], minlength=len(at))
    label[(label >= 0) & (size[label] < 2)] = -1
    return label


def _ties(member: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members, in order, whose group (a new one starts where `new` is set) has two or more, and their groups."""
    if not len(member):
        return member, np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate(([0], new)))
    keep = np.bincount(group)[group] > 1
    return member[keep], group[keep]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), for each i."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _pack_anchors(ids: list, texts: list[bytes]):
    """Anchors of a pack's texts with an id, and the distinct keys with whether two documents of the pack hold them."""
    got = []
    for first, part in runs(texts):
        text, lo, hi, key = anchors([t if ids[first + i] is not None else b"" for i, t in enumerate(part)])
        got.append((text + first, lo, hi, key))
    text, lo, hi, key = (np.concatenate(x) for x in zip(*got)) if got else anchors([])
    distinct, at = np.unique(key, return_inverse=True)
    order = np.lexsort((text, at))
    new = np.concatenate(([True], (at[order][1:] != at[order][:-1]) | (text[order][1:] != text[order][:-1]))) if len(order) else np.zeros(0, bool)
    shared = np.bincount(at[order][new], minlength=len(distinct)) > 1
    return text, lo, hi, at, distinct, shared


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long), n_bytes, n_removed, n_spans and kept (binary) of every row.

    A byte goes if a string of WIDTH bytes over it also starts in a document with a smaller id, judged on the input. A null
    text is empty. Rows without an id lose nothing and take nothing; rows that share an id take nothing from each other.
    An empty table gives an empty table.
    """
    shards = shard_count(docs, 512)
    packs = build_packs(docs, id_col, text_col, PACK_BYTES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                *_, distinct, _ = _pack_anchors(row["ids"], texts_of(row["blob"]))
                yield bundles([(s, row["pack"], squeeze(distinct[at])) for s, at in by_shard(distinct, shards)], "shard pack blob")

    def seen_twice(key: tuple, asked: pa.Table) -> pa.Table:
        keys = [unsqueeze(b)[0] for b in asked.column("blob").to_pylist()]
        distinct, at, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        again = np.split(counts[at] > 1, np.cumsum([len(k) for k in keys])[:-1])
        return pa.Table.from_batches([bundles([(p, key[0].as_py(), np.packbits(a).tobytes()) for p, a in zip(asked.column("pack").to_pylist(), again, strict=True)], "pack shard answer")])

    def send(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        ids, texts = own.column("ids")[0].as_py(), texts_of(own.column("blob")[0].as_py())
        text, lo, hi, at, distinct, repeated = _pack_anchors(ids, texts)
        masks = dict(zip(got.column("shard").to_pylist(), got.column("answer").to_pylist(), strict=True))
        for shard, where in by_shard(distinct, shards):
            repeated[where] |= np.unpackbits(np.frombuffer(masks[shard], np.uint8), count=len(where)).astype(bool)
        keep = np.flatnonzero(repeated[at])
        text, lo, hi, at = text[keep], lo[keep], hi[keep], at[keep]
        stretch = [texts[t][a:b] for t, a, b in zip(text.tolist(), lo.tolist(), (hi + WIDTH).tolist())]
        doc = np.array([ids[t] for t in text.tolist()], np.int64)
        # of equal stretches in the pack only those of the smallest document travel; larger documents lose them here
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(s, len(number)) for s in stretch), np.int64, len(stretch))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc)
        lost = doc > least[same]
        rows = [(int(key[0].as_py() % shards), key[0].as_py(), squeeze(np.zeros(0, np.int64), text[lost].astype(np.int32), lo[lost].astype(np.int32), (hi - lo + WIDTH)[lost].astype(np.int32)))]
        stay = np.flatnonzero(~lost)
        for shard, where in by_shard(distinct[at[stay]], shards):
            pick = stay[where]
            size = np.array([len(stretch[i]) for i in pick.tolist()], np.int32)
            body = np.frombuffer(b"".join([stretch[i] for i in pick.tolist()]), np.uint8)
            rows.append((shard, key[0].as_py(), squeeze(doc[pick], text[pick].astype(np.int32), lo[pick].astype(np.int32), size, body)))
        return pa.Table.from_batches([bundles(rows, "shard pack blob")])

    def sort(key: tuple, sent: pa.Table) -> pa.Table:
        packs_of, rows, got = sent.column("pack").to_pylist(), [], []
        for i, blob in enumerate(sent.column("blob").to_pylist()):
            parts = unsqueeze(blob)
            if len(parts) == 4:  # spans that the pack settled itself
                rows.append((packs_of[i], squeeze(*parts[1:])))
            else:
                got.append((np.full(len(parts[0]), i), *parts))
        if got:
            source, doc, text, lo, size, body = (np.concatenate(x) for x in zip(*got))
            size = size.astype(np.int64)
            start = np.cumsum(size) - size
            hashed = span_hashes(prefix_sums(body), start, start + size)
            _, first, same = np.unique(hashed, return_index=True, return_inverse=True)  # distinct stretches
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, same, doc)
            windows = size[first] - WIDTH + 1
            flat, of = _spread(start[first], windows), np.repeat(np.arange(len(first)), windows)
            label = sort_windows(body, flat)
            tied = label >= 0
            smallest = np.full(len(flat), np.iinfo(np.int64).max)
            np.minimum.at(smallest, label[tied], least[of[tied]])
            gone = np.zeros(len(flat), bool)
            gone[tied] = smallest[label[tied]] < least[of[tied]]
            # runs of windows that the smallest holder of a stretch loses; larger holders lose all of it
            edge = np.flatnonzero(gone)
            begin = edge[np.concatenate(([True], (edge[1:] != edge[:-1] + 1) | (of[edge[1:]] != of[edge[:-1]])))] if len(edge) else edge
            finish = edge[np.concatenate(((edge[1:] != edge[:-1] + 1) | (of[edge[1:]] != of[edge[:-1]]), [True]))] if len(edge) else edge
            base = np.cumsum(windows) - windows
            per = np.bincount(of[begin], minlength=len(first))
            whole = np.flatnonzero(doc > least[same])
            part = np.flatnonzero((doc == least[same]) & (per[same] > 0))
            run = _spread((np.cumsum(per) - per)[same[part]], per[same[part]])
            holder = np.repeat(part, per[same[part]])
            s = np.concatenate([source[whole], source[holder]])
            t = np.concatenate([text[whole], text[holder]])
            a = np.concatenate([lo[whole], lo[holder] + (begin[run] - base[of[begin[run]]])])
            n = np.concatenate([size[whole], finish[run] - begin[run] + WIDTH])
            order = np.argsort(s, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
                if len(at):
                    rows.append((packs_of[s[at[0]]], squeeze(t[at].astype(np.int32), a[at].astype(np.int32), n[at].astype(np.int32))))
        return pa.Table.from_batches([bundles(rows, "pack spans")])

    def cut_out(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        ids, texts = own.column("ids")[0].as_py(), texts_of(own.column("blob")[0].as_py())
        spans = [unsqueeze(b) for b in got.column("spans").to_pylist()]
        text, lo, size = (np.concatenate(x).astype(np.int64) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((lo, text))
        text, lo, hi = text[order], lo[order], (lo + size)[order]
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        kept, removed, count = [], [], []
        for i, t in enumerate(texts):
            parts, end, gone, n = [], 0, 0, 0
            for a, b in zip(lo[bounds[i] : bounds[i + 1]].tolist(), hi[bounds[i] : bounds[i + 1]].tolist()):
                if a > end or n == 0:
                    parts.append(t[end:a])
                    n += 1
                    gone += b - a
                    end = b
                elif b > end:
                    gone += b - end
                    end = b
            kept.append(b"".join([*parts, t[end:]]) if n else t)
            removed.append(gone)
            count.append(n)
        return pa.table([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    answers = packs.mapInArrow(ask, "shard long, pack long, blob binary").groupBy("shard").applyInArrow(seen_twice, "pack long, shard long, answer binary")
    sent = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(send, "shard long, pack long, blob binary")
    spans = sent.groupBy("shard").applyInArrow(sort, "pack long, spans binary")
    return packs.groupBy("pack").cogroup(spans.groupBy("pack")).applyInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

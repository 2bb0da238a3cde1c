"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from corvex.llm import bpe, decontamination, line_dedup, packs, pii_crf, pitman_yor, quality, simhash, spotsigs, suffix_dedup, token_count
from corvex.llm.components import components
from corvex.llm.queries import QUERIES, SQL
from tests.oracle import SF, assert_matches, connect

SCHEMA = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "\n\n", "don't 'tis ''s 'll 're 'r", "<|endoftext|>a<|startoftext|>b", "Σίσυφος ΑΣ İx ẞ ﬁ", "a b\x1cc\x85d", "日本語 123４５ ¾", "x" * 3000, "!?" * 400, "é É", "😀👩‍👩‍👧", "'" * 9, "tab\t\ttab  end  ", "a\nb\n"]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated, tied and long texts, a null id, and columns whose names clash with results."""
    rows = [(1, "Shared line of text\nown one here"), (2, "shared LINE of text  \nother"), (3, None), (4, ""), (5, "Shared line of text\nown one here"), (5, "Shared line of text\nown one here"), (None, "shared line of text"), (7, "word " * 30000), (8, "é" * 60), (9, "é" * 60)]
    return spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], SCHEMA + ", n_tokens int, fp string, key string")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1

def test_op1_sql(spark):
    assert_matches(spark, connect(), QUERIES["op1_line_dedup"], SQL["op1_line_dedup"])


def test_op1_odd(spark, odd):
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd).collect()]
    by = collections.defaultdict(list)
    for i, *rest in got:
        by[i].append(tuple(rest))
    assert by[1] == [("Shared line of text\nown one here", 2, 0)]
    assert by[2] == [("other", 2, 1)]
    assert by[3] == [("", 1, 0)] and by[4] == [("", 1, 0)]
    assert by[5] == [("", 2, 2)] * 2
    assert by[None] == [("shared line of text", 1, 0)]
    assert by[8][0][2] == 0 and by[9] == [("", 1, 1)]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_once_twice_filter():
    a, b = line_dedup.OnceTwice(1 << 14), line_dedup.OnceTwice(1 << 14)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, 500, np.uint64), rng.integers(0, 1 << 63, 500, np.uint64)
    a.add(x)
    b.add(np.concatenate([y, x[:50]]))
    a.merge(np.arange(1 << 14), b.once, b.twice)
    hit = lambda h: ((a.twice[(p := line_dedup._place(h, 1 << 14))[0]] & p[1]) == p[1])
    assert hit(x[:50]).all() and hit(x[50:]).mean() < 0.05


# 2

def test_op2_finds_substituted_passages(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    tests = {i: make(30) for i in range(8)}
    docs, want = [], set()
    for d in range(60):
        body = make(80)
        if d % 3 == 0:
            item = d // 3 % 8
            passage = [w if k % 9 != 4 else "zzz" for k, w in enumerate(tests[item])]
            body[20:20] = passage
            want.add((d, item))
        docs.append((d, " ".join(body).upper() if d % 2 else ", ".join(body)))
    docs += [(100, None), (101, ""), (None, " ".join(tests[0])), (102, " ".join(tests[0])), (102, " ".join(tests[0]))]
    frame, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(i, " ".join(t)) for i, t in tests.items()] + [(99, None), (None, "x")], "item_id long, text string")
    for limit in (1 << 20, 0):
        got = collections.Counter((r.doc_id, r.item_id) for r in decontamination.find_overlaps(frame, bench, broadcast_seeds=limit).collect())
        assert set(got) == want | {(102, 0)}
    left = {r.doc_id for r in decontamination.decontaminate(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want} - {102}
    assert decontamination.find_overlaps(empty(spark), bench).count() == 0
    assert decontamination.find_overlaps(frame, bench.limit(0)).count() == 0


def test_op2_masks_tolerate_any_single_substitution():
    assert all(len(m) == decontamination.SPAN for m in decontamination.MASKS)
    assert all(any(m[i] == "0" for m in decontamination.MASKS) for i in range(decontamination.SPAN))


# 3 and 5

def test_op3_equals_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    texts = HARD + list(documents(spark).values())[:60]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], SCHEMA)
    got = {r.doc_id: r for r in bpe.digest_documents(frame, BYTE).collect()}
    for i, t in enumerate(texts + [""]):
        ids = library.encode(t, add_special_tokens=False).ids
        r = got[i if i < len(texts) else 9999]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    both = bpe.decode_documents(bpe.encode_documents(frame, BYTE), BYTE)
    assert both.where("decoded <> text OR NOT round_trip").count() == 0
    assert bpe.digest_documents(empty(spark), BYTE).count() == 0


def test_op3_forced_cuts():
    model = bpe.load(BYTE)
    pairs = {(a, b) for t in model.ids for a, b in zip(t, t[1:])}
    for text in ("hello world", "x~~q", "日本"):
        raw = text.encode()
        assert model.cuts(np.frombuffer(raw, np.uint8)).tolist() == [i == 0 or (raw[i - 1], raw[i]) not in pairs for i in range(len(raw))]
    assert model.decode([model.ids[b"\xe6"]]) == "�"


def test_op3_stretches_and_matrices():
    """White space of every kind and run, special tokens, and fragments on both sides of the widest matrix, in one slice."""
    from tokenizers import Tokenizer

    library, model, rng = Tokenizer.from_file(BYTE), bpe.load(BYTE), random.Random(1)
    signs = [" ", "  ", "\n", "\t", "\u00a0", "\x85", "\u2003", "\x1c", "'s", "'", "a", "b ", "Z", "1", "９", "é", "日", "!", "?", "<|endoftext|>", "\r\n", "\u0301", "\u3000", "x" * 63, "x" * 64, "x" * 65, "ab" * 300]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in model.encode_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op3_odd(spark, odd):
    got = bpe.digest_documents(odd, BYTE)
    assert got.columns == ["doc_id", "text", "fp", "key", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == 10 and all(r.decoded_sha256 == sha(r.text or "") for r in rows)
    by = collections.Counter((r.doc_id, r.n_tokens) for r in rows)
    assert by[3, 0] == by[4, 0] == 1 and by[7, 30000 + 1] + by[7, 30000] == 1 and sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1


def test_op3_op5_all_code_points():
    """Every code point, assigned or not, beside a letter, a digit, a sign and a space, against the libraries."""
    from tokenizers import Tokenizer

    own, counter = bpe.load(BYTE), token_count.load(WORD)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{x}1{x}!{x} {x}" for x in map(chr, points[i : i + 64])) for i in range(0, len(points), 64)]
    rng = random.Random(6)
    texts += ["".join(chr(rng.choice(points)) + rng.choice(["", "a", "1", "'s", " ", "\u0301"]) for _ in range(30)) for _ in range(1500)]
    for i in range(0, len(texts), 2000):
        part = texts[i : i + 2000]
        assert [x.tolist() for x in own.encode_all(part)] == [e.ids for e in byte.encode_batch(part, add_special_tokens=False)]
        want = [len(e.ids) for e in word.encode_batch(part, add_special_tokens=False)]
        assert [t for t, a, b in zip(part, counter.count(part), want) if a != b] == []


def test_op5_equals_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab'stmdrvel !1 \n\té") for _ in range(rng.randint(1, 25))) for _ in range(400)] + list(documents(spark).values())[:60]
    got = {r.doc_id: r for r in token_count.count_tokens(spark.createDataFrame(list(enumerate(texts)), SCHEMA), WORD).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 2048), t
    out = token_count.count_tokens(odd, WORD)
    assert out.columns.count("n_tokens") == 1 and out.where("doc_id = 3").first().n_tokens == 0 and out.where("doc_id = 7").first().over_limit
    assert token_count.count_tokens(empty(spark), WORD).count() == 0


# 4

def test_op4_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.3
    cast = np.stack([np.where(rng.random(20000) < 0.6, np.where((rng.random(20000) < acc) == truth, 2, 1), 0) for acc in (0.95, 0.8, 0.7)], 1)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    bad, prior, table = quality.estimate(patterns, counts.astype(float))
    said_bad = table[:, 1, 2] / table[:, 1, 1:].sum(1)
    assert np.abs(said_bad - [0.95, 0.8, 0.7]).max() < 0.06 and bad[(patterns == 2).all(1)][0] > 0.9
    assert abs(prior[1] - 0.3) < 0.05
    by_hand = [math.prod(table[k, 1, v] for k, v in enumerate(p)) * prior[1] for p in patterns.tolist()]
    other = [math.prod(table[k, 0, v] for k, v in enumerate(p)) * prior[0] for p in patterns.tolist()]
    assert np.allclose(quality.posterior(patterns, prior, table), np.array(by_hand) / (np.array(by_hand) + other))
    assert len(quality.estimate(np.zeros((0, 7), np.int64), np.zeros(0))[0]) == 0


def test_op4_held_out_accuracy(spark):
    """Fit with half of the labels, judged on the other half."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    truth = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.where("doc_id % 2 = 1").collect()}  # the scorer saw none of these
    assert np.mean([got[i] == keep for i, keep in truth.items()]) > 0.9
    assert np.mean([got[i] for i, keep in truth.items() if keep]) > 0.95


def test_op4_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels)
    assert got.columns == ["doc_id", "score", "weak_bad", "keep"]
    keeps = collections.defaultdict(set)
    for r in got.collect():
        keeps[r.doc_id].add((r.score, r.weak_bad, r.keep))
    assert keeps[1] == keeps[5]  # equal texts, one with a label: no document is judged by its own
    assert got.count() == 10 and got.where("score IS NULL OR weak_bad IS NULL OR keep IS NULL").count() == 0
    assert quality.classify(odd, labels.limit(0)).count() == 10
    assert quality.classify(empty(spark), labels).count() == 0


def test_op4_empty_labels_say_nothing(spark):
    """Toxic documents with a label row of nulls are judged as if they had none."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    make = lambda bad: " ".join(rng.choice(vocab) if not bad or k % 4 else rng.choice(["zzrude", "zzcrude", "zzvile", "zzfoul"]) for k in range(60))
    docs = spark.createDataFrame([(i, make(i % 10 == 0)) for i in range(400)], SCHEMA)
    labels = [(i, 1, int(i % 10 == 0)) for i in range(300)]
    null = [(i, None, None) for i in range(300, 400)]
    schema = "doc_id long, quality int, toxic int"
    plain = {r.doc_id: r.keep for r in quality.classify(docs, spark.createDataFrame(labels, schema)).collect()}
    assert plain == {r.doc_id: r.keep for r in quality.classify(docs, spark.createDataFrame(labels + null, schema)).collect()}
    assert {i for i, keep in plain.items() if not keep} == set(range(0, 400, 10))


def escaping_stretch(masks, least=13):
    """A run of matches and substitutions with `least` matches and a score above zero throughout, in which no mask fits; else None."""
    fits = [m.strip("0") for m in masks]
    todo, seen = [("1", 1, 1)], set()
    while todo:
        run, score, matches = todo.pop()
        if matches >= least:
            return run
        for bit in "10":
            after, left = run + bit, score + (1 if bit == "1" else -decontamination.MISMATCH)
            hit = any(len(after) >= len(m) and all(x == "1" or y == "0" for x, y in zip(after[-len(m) :], m)) for m in fits)
            state = (after[-decontamination.SPAN :], left, matches + (bit == "1"))
            if left > 0 and not hit and state not in seen:
                seen.add(state)
                todo.append((after, *state[1:]))
    return None


def test_op2_no_long_stretch_escapes_the_masks():
    assert escaping_stretch(decontamination.MASKS) is None
    for i in range(4, len(decontamination.MASKS)):  # each of the last three is needed
        assert escaping_stretch(decontamination.MASKS[:i] + decontamination.MASKS[i + 1 :])


def test_op2_finds_every_fourth_token_substituted(spark):
    item = [f"i{k}" for k in range(80)]
    docs = [(period * 10 + shift, " ".join("zzz" if (k + shift) % period == 0 else w for k, w in enumerate(item))) for period in (3, 4, 5, 6) for shift in range(period)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for limit in (1 << 20, 0):
        got = {r.doc_id for r in decontamination.find_overlaps(spark.createDataFrame(docs, SCHEMA), bench, broadcast_seeds=limit).collect()}
        assert got == {d for d, _ in docs if d >= 40}


def test_op2_finds_every_placement_of_substitutions(spark):
    """Items of 1 to 20 tokens with a fifth substituted, of 15 to 20 with two and three, at every placement; cut items and passages of one id."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 21)}
    docs, want = [], set()
    for n, item in items.items():
        for count in {n // 5, *((2, 3) if 15 <= n <= 20 else ())}:
            for places in itertools.combinations(range(n), count):
                want.add((len(docs), n))
                docs.append((len(docs), " ".join(["before", "it", *("zzz" if k in places else w for k, w in enumerate(item)), "and", "after"])))
        for cut in {n // 5} - {0}:
            want |= {(len(docs), n), (len(docs) + 1, n)}
            docs += [(len(docs), " ".join(item[cut:])), (len(docs) + 1, " ".join(item[: n - cut]))]
        if n < 17:
            docs.append((len(docs), " ".join(item[: n - n // 5 - 1]) + " beyond"))
    want |= {(-1, 50), (-2, 50), (-3, 50)}
    first, second = " ".join(f"a{k}" for k in range(16)), " ".join(f"b{k}" for k in range(16))
    docs += [(-1, first), (-2, second), (-3, f"{second} {first}")]
    frame = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()] + [(50, first), (50, second), (50, second)], "item_id long, text string")
    for limit in (1 << 20, 0):
        got = collections.Counter((r.doc_id, r.item_id) for r in decontamination.find_overlaps(frame, bench, broadcast_seeds=limit).collect())
        assert set(got) == want and set(got.values()) == {1}


# 6

def brute_components(fps, distance):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sum((int(x) ^ int(y)).bit_count() for x, y in zip(fps[a], fps[b])) <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op6_against_brute_force(spark, monkeypatch):
    docs = documents(spark)
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "OWN_BLOCK", 4)
    monkeypatch.setattr(simhash, "VISIT_BLOCK", 16)
    frame = spark.createDataFrame(list(docs.items()), SCHEMA)
    got = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
    fps = {}
    for i, t in docs.items():
        w = words(t)
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = (sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0,)
    assert {i: r.key & (1 << 64) - 1 for i, r in got.items()} == {i: f[0] for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps, 3)


def test_op6_finds_every_link_of_dense_clusters(spark, monkeypatch):
    """Fingerprints planted within three bits, in chains and clusters, none lost."""
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "OWN_BLOCK", 8)
    rng = random.Random(4)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(63)
        for _ in range(rng.randint(1, 12)):
            values.add(x)
            for b in rng.sample(range(63), rng.randint(1, 4)):
                x ^= 1 << b
    values = sorted(values)
    frame = spark.createDataFrame([(v, bytearray(v.to_bytes(8, "little"))) for v in values], "key long, fp binary")
    roots = {r.id: r.root for r in components(simhash.link_fingerprints(frame, 3, simhash.halves(), 1)).collect()}
    want = brute_components({v: (v,) for v in values}, 3)
    assert {v: roots.get(v, v) for v in values} == want


def test_op6_wide_recall(spark):
    rng = random.Random(6)
    texts, pairs = [], []
    for i in range(150):
        w = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
        texts.append(" ".join(w))
        for k in rng.sample(range(300), 5):
            w[k] = "changed"
        texts.append(" ".join(w))
        pairs.append((2 * i, 2 * i + 1))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA), width=5, size=4, distance=51, trees=40, bits=13).collect()}
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.98
    assert len(set(got.values())) >= 150


def test_op6_odd(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r.component_id for r in got}
    assert by[3] == by[4] == 3 and by[5] == 1 and by[9] == 8
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    parent = list(range(500))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in range(500))


# 7

def brute_repeats(docs):
    first = {}
    for i, t in docs.items():
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    out = {}
    for i, t in docs.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = (len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])), bytes(c for c, g in zip(t, gone) if not g))
    return out


def test_op7_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = "".join(rng.choice("ab cé") for _ in range(3000))
    docs = {i: "".join(base[(a := rng.randint(0, 2900)) : a + rng.randint(10, 160)] for _ in range(rng.randint(0, 6))) for i in range(60)}
    docs |= {80: "a" * 500, 81: "a" * 300, 82: "ab" * 200, 83: "", 84: "x" * 49, 85: "x" * 50, 86: "x" * 51}
    docs |= {1000 + i: t for i, t in list(documents(spark).items())[:60]}
    monkeypatch.setitem(packs.build_packs.__globals__, "PACK_ROWS", 7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()}
    assert got == brute_repeats({i: t.encode() for i, t in docs.items()})


def test_op7_odd(spark, odd):
    got = collections.defaultdict(list)
    for r in suffix_dedup.remove_repeats(odd).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed))
    assert got[3] == got[4] == [(0, 0)] and got[9] == [(120, 120)] and got[8] == [(120, 0)] and got[7] == [(150000, 0)]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_op7_window_sort():
    rng = random.Random(8)
    body = "".join(rng.choice("ab") for _ in range(300)) * 3 + "".join(rng.choice("ab") for _ in range(200))
    raw = np.frombuffer(body.encode(), np.uint8)
    at = np.arange(len(body) - 49)
    label = suffix_dedup.sort_windows(raw, at)
    groups = collections.defaultdict(list)
    for p in at.tolist():
        groups[body[p : p + 50]].append(p)
    for members in groups.values():
        labels = {int(label[p]) for p in members}
        assert len(labels) == 1 and (labels == {-1}) == (len(members) == 1)


# 8

def test_op8_base_and_perplexity(spark):
    docs = documents(spark)
    frame = spark.createDataFrame([*docs.items(), (10**6, None), (None, "a b")], SCHEMA)
    rows = pitman_yor.score_documents(frame).collect()
    tok = {i: words(t) + [None] for i, t in [*docs.items(), (10**6, None), (None, "a b")]}
    c = collections.Counter()
    for i, w in tok.items():
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = tok[r.doc_id]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
    out = [r for r in rows if r.held_out]
    total = sum(r.n_tokens for r in out)
    assert -sum(r.score for r in out) / total < -sum(r.base_score for r in out) / total
    assert pitman_yor.score_documents(empty(spark)).count() == 0


def test_op8_probabilities_sum_to_one(spark):
    """Over all known words and the unknown one, after every context; and the query's scores are those probabilities."""
    texts = ["a b a c", "b a", "c c a b", "a", "b b", "a b c a b c a b"]
    frame = spark.createDataFrame([*enumerate(texts)], SCHEMA)
    built = packs.build_packs(frame)
    counts, world = pitman_yor.fit(built, 8)
    contexts, mass, p = np.arange(pitman_yor.CONTEXTS), np.zeros(pitman_yor.CONTEXTS), {}
    kept = world["totals"][pitman_yor.BURN_IN:]
    seen = collections.Counter()
    for r in counts.collect():
        seating = pitman_yor.Seating(r.shard, r.blob, world | {"totals": world["totals"][:-1]})
        parents = [pitman_yor.parent_probability(c, a, total, world) for (_, c, a), total in zip(seating.kept[pitman_yor.BURN_IN:], kept)]
        for i, w in enumerate(seating.words.tolist()):
            n, tables = np.zeros(len(contexts)), [np.zeros(len(contexts)) for _ in kept]
            mine = np.flatnonzero(seating.of_word == i)
            n[seating.pair_context[mine]] = seating.pair_n[mine]
            seen[w] += int(n.sum())
            for k, (t, _, _) in enumerate(seating.kept[pitman_yor.BURN_IN:]):
                tables[k][seating.pair_context[mine]] = t[mine]
            p[w] = pitman_yor.predictive(world, contexts, n, tables, [np.full(len(contexts), x[i]) for x in parents])
            mass += p[w]
    none = [np.full(len(contexts), pitman_yor.parent_probability(0.0, 0.0, total, world)) for total in kept]
    unknown = pitman_yor.predictive(world, contexts, np.zeros(len(contexts)), [np.zeros(len(contexts))] * len(kept), none)
    assert np.allclose(mass + unknown, 1)
    learned = [i for i in range(len(texts)) if pitman_yor.learns(i)]
    assert sum(seen.values()) == sum(len(words(texts[i])) + 1 for i in learned) == world["N"]
    for r in pitman_yor.score_documents(spark.createDataFrame([*enumerate(texts), (None, "zz a"), (None, "")], SCHEMA)).collect():
        text = texts[r.doc_id] if r.doc_id is not None else "zz a" if r.n_tokens == 3 else ""
        _, word, context = pitman_yor.tokens([text.encode()])
        want = sum(math.log10(p[w][c] if w in p else unknown[c]) for w, c in zip(word.tolist(), context.tolist()))
        assert abs(r.score - want) < 0.25 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-9  # seats are drawn anew where shards differ


def test_op8_learns_which_word_follows(spark):
    """Words that end alike but are followed by different ones: a context tells them apart."""
    rng = random.Random(5)
    texts = [" ".join(x for _ in range(40) for x in rng.choice([("the", "cat"), ("we", "run"), ("he", "sits"), ("are", "gone")])) for _ in range(60)]
    probe = dict(zip((i for i in range(1000, 2000) if not pitman_yor.learns(i)), ["the cat", "we cat", "are gone", "he gone"]))
    rows = pitman_yor.score_documents(spark.createDataFrame([*enumerate(texts), *probe.items()], SCHEMA)).where("doc_id >= 1000").collect()
    score = {probe[r.doc_id]: r.score for r in rows}
    assert score["the cat"] > score["we cat"] + 0.5 and score["are gone"] > score["he gone"] + 0.5


def test_op8_words_of_one_slot_have_restaurants_of_their_own(spark):
    """Both words shared one restaurant before, so that what follows either was as likely after the other."""
    from corvex.llm.vec import U, Words, mix

    pool = [f"w{i}" for i in range(2000)]
    slot = (mix(Words([" ".join(pool).encode()]).hashes) % U(pitman_yor.START)).tolist()
    a, b = next((pool[slot.index(x)], pool[i]) for i, x in enumerate(slot) if slot.index(x) < i)
    texts = [" ".join([f"{a} cat"] * 30 + [f"{b} dog"] * 20)] * 40
    probe = dict(zip((i for i in range(1000, 2000) if not pitman_yor.learns(i)), [f"{a} cat", f"{a} dog", f"{b} cat", f"{b} dog"]))
    rows = pitman_yor.score_documents(spark.createDataFrame([*enumerate(texts), *probe.items()], SCHEMA)).where("doc_id >= 1000").collect()
    score = {probe[r.doc_id]: r.score for r in rows}
    assert score[f"{a} cat"] > score[f"{a} dog"] + 1 and score[f"{b} dog"] > score[f"{b} cat"] + 1


@pytest.mark.parametrize("owned", [0, 3])
def test_op8_restaurants_of_words_without_a_slot(spark, monkeypatch, owned):
    """With few owners or none: tables that come back are the sums over all shards, probabilities sum to one, and scores are those probabilities."""
    find = pitman_yor.find_owners
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", weights=range(8, 0, -1), k=60)) + f" once{i}" for i in range(25)]

    def few(built):
        out = find(built)
        out[np.flatnonzero(out)[owned:]] = 0
        return out

    monkeypatch.setattr(pitman_yor, "find_owners", few)
    frame = spark.createDataFrame([*enumerate(texts)], SCHEMA).coalesce(1)
    counts, world = pitman_yor.fit(packs.build_packs(frame), 8)
    told, kept, all_totals = world.pop("told").toArrow(), pitman_yor.BURN_IN, world["totals"]
    tables, pairs, parents = [collections.Counter() for _ in all_totals], {}, {}
    customers = collections.Counter()
    for r in counts.collect():
        mine = told.filter([x == r.shard for x in told.column("shard").to_pylist()])
        s = pitman_yor.Seating(r.shard, r.blob, world | {"totals": all_totals[:-1]}, lambda asked, mine=mine: pitman_yor._told(mine, asked, 8))
        for k, (t, c, above) in enumerate(s.kept):
            for place, x in zip(s.pair_place.tolist(), t.tolist()):
                tables[k][place] += x
            for i, w in enumerate(s.words.tolist()):
                parents.setdefault(w, []).append(pitman_yor.parent_probability(c[i], above[i], all_totals[k], world))
        for i, place, n, *t in zip(s.of_word.tolist(), s.pair_place.tolist(), s.pair_n.tolist(), *(x[0].tolist() for x in s.kept)):
            customers[place] += n
            pairs[s.words.tolist()[i], place] = n, t
    for r in counts.collect():
        mine = told.filter([x == r.shard for x in told.column("shard").to_pylist()])
        asked = pitman_yor.Sweeps(r.shard, r.lean, world | {"totals": []}).asked
        for k, got in enumerate(pitman_yor._told(mine, asked, 8)):
            end = [int(p) for p in (pitman_yor.WHOLE | pitman_yor._idents(np.array([pitman_yor.END], np.uint64)))]
            assert all(x == tables[k][p] for p, x in zip(asked.tolist(), got.tolist()) if p not in end)
    assert len([p for p in customers if p >= pitman_yor.CONTEXTS]) >= 20 and sum(world["C"] > 0) == owned + 1
    none = [pitman_yor.parent_probability(0.0, 0.0, x, world) for x in all_totals]

    def chance(w, place):
        n, t = pairs.get((w, place), (0, [0] * len(all_totals)))
        ps = parents.get(w, none)
        return sum((n - world["d"] * t[k] + (pitman_yor.STRENGTH + world["d"] * tables[k][place]) * ps[k]) / (pitman_yor.STRENGTH + customers[place]) for k in range(kept, len(all_totals))) / (len(all_totals) - kept)

    for place in customers:
        assert abs(sum(chance(w, place) for w in parents) + chance(None, place) - 1) < 1e-9
    for r in pitman_yor.score_documents(frame).collect():
        _, word, before = pitman_yor._walk([texts[r.doc_id].encode()])
        want = sum(math.log10(chance(w, place)) for w, place in zip(word.tolist(), pitman_yor.places(before, world["owner"]).tolist()))
        assert abs(r.score - want) < 1e-3


def test_op8_requests_are_places_in_the_shard(spark):
    """A pack names its words and contexts once, when they are counted; what it asks for is kept as places, of about a byte, for held-out texts too."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 300) % 5000) for _ in range(300)]
    built = packs.build_packs(spark.createDataFrame([*enumerate(texts)], SCHEMA).repartition(3))
    owner = pitman_yor.find_owners(built)
    want, size, n_pairs = {}, 0, 0
    for r in built.collect():
        word, spread, place, _ = pitman_yor.distinct_pairs(packs.texts_of(r.blob), owner)
        want[r.pack] = set(zip(np.repeat(word, spread).tolist(), place.tolist()))
    shards = pitman_yor.count_shards(built, 8, owner).collect()
    learned, unlearned, got = set(), set(), {pack: set() for pack in want}
    for r in shards:
        s = pitman_yor.Seating(r.shard, r.blob, {"owner": owner, "V": 10, "d": 0.5, "d0": 0.5, "totals": []})
        pairs = list(zip(s.words[s.of_word].tolist(), s.pair_place.tolist()))
        learned |= set(pairs)
        known_words, known_pairs, asked = pitman_yor.asked_of(r.asks)
        assert known_words.sum() == len(s.words) and known_pairs.sum() == len(pairs)
        size += len(r.asks)
        for pack, word_at, pair_at in asked:
            n_pairs += len(pair_at)
            inside = known_pairs[pair_at]
            got[pack] |= {pairs[i] for i in (np.cumsum(known_pairs) - 1)[pair_at[inside]]}
            own = {w for w, _ in want[pack]} & set(s.words.tolist())
            assert [s.words[i] for i in (np.cumsum(known_words) - 1)[word_at[known_words[word_at]]]] == sorted(own)
    for pack, pairs in want.items():
        assert got[pack] == pairs & learned
        unlearned |= pairs - learned
    assert unlearned and n_pairs == sum(map(len, want.values())) and size < 3 * n_pairs


def test_op8_shards_without_a_learned_text(spark):
    """All texts held out: every shard is asked, none has counts."""
    out = [i for i in range(200) if not pitman_yor.learns(i)]
    rows = pitman_yor.score_documents(spark.createDataFrame([(i, f"some words {i}") for i in out], SCHEMA)).collect()
    assert {r.doc_id for r in rows} == set(out)
    assert all((r.n_tokens, r.n_known, r.train_tokens) == (4, 0, 0) and abs(r.score) < 1e-9 and r.held_out for r in rows)


def test_op8_seating():
    rng = np.random.default_rng(0)
    n = np.array([0, 1, 2, 10, 1000])
    t = pitman_yor.seat(n, np.full(5, 1.0), 0.5, rng)
    assert t[0] == 0 and t[1] == 1 and (t <= n).all() and 3 <= t[4] < 100


# 9

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)] + [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii_crf.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_op9_base_spans():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice("01.2@a+- ()é5") for _ in range(rng.randint(0, 60)))
        assert pii_crf.base_spans(t) == plain_spans(t)


def test_op9_query(spark):
    docs = documents(spark)
    for r in QUERIES["op9_personal_data"](spark, SF).collect():
        base = plain_spans(docs[r.doc_id])
        shown = [f"{pii_crf.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in base) for n in range(4))
        assert r.base_sha256 == sha(",".join(shown)) and set(shown) <= set(r.spans.split(",") if r.spans else [])


def test_op9_skip_links_carry_labels(spark):
    """A number that the patterns find once is found where it repeats without its plus sign."""
    rows = [(i, f"call +49 30 5550{i:03d}77 now") for i in range(200)] + [(500, "reach +1 987 555 24 85 or later 987 at noon"), (501, None), (502, "")]
    found = {r.doc_id: r for r in pii_crf.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found[0].base_spans) == 1 and found[501].spans == [] and found[502].spans == []
    nodes = pii_crf.Nodes()
    text = "x 987555 y 987555 z"
    nodes.add(0, text, [(3, 2, 8)])
    assert nodes.skip == [(0, 1)] and nodes.labels == [4, 0]
    model = {"prior": np.log(np.full(5, 0.2)), "unary": np.zeros((pii_crf.BUCKETS, 5)), "chain": np.zeros((5, 5)), "skip": np.eye(5) * 3 - 1}
    model["unary"][nodes.features[0][3], 4] = 20
    assert pii_crf.beliefs(nodes, model)[1].argmax() == 4
    assert pii_crf.find_personal_data(empty(spark)).count() == 0


# 10

def test_op10_edited_texts(spark):
    docs = documents(spark)
    ids = sorted(docs)
    rows = spotsigs.fingerprint_documents(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()
    assert len(rows) == len(docs)
    sets = {r.doc_id: set(r.fingerprint.split(",")) for r in rows}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    for r in rows:
        t, nxt = docs[r.doc_id], ids[(ids.index(r.doc_id) + 1) % len(ids)]
        half = len(t) // 2
        assert (r.n_chars, r.edited_text) == (len(t), t[: len(t) - half] + docs[nxt][:half])
        near = jaccard(sets[r.doc_id], sets[nxt])
        assert abs(r.near_next - near) < 1e-9 or (near < 0.01 and r.near_next == 0)
        near = jaccard(sets[r.doc_id], set(r.edited_fingerprint.split(",")))
        assert abs(r.near_edited - near) < 1e-9 or (near < 0.01 and r.near_edited == 0)


def test_op10_signatures(spark):
    df = spark.createDataFrame([("The quick of the brown fox, and a lazy dog",), ("THE quick -- of brown fox and lazy dog!",), ("",), ("nothing",)], "t string")
    a, b, e, n = (r.s for r in df.select(spotsigs.signatures(F.col("t")).alias("s")).collect())
    assert len(set(a) & set(b)) >= 2 and len(e) == len(n) == 1 and e != n


def test_op10_odd(spark, odd):
    got = spotsigs.fingerprint_documents(odd).collect()
    assert len(got) == 10 and len({r.fingerprint for r in got if r.doc_id in (1, 5)}) == 1
    assert spotsigs.fingerprint_documents(empty(spark)).count() == 0
    only = spotsigs.fingerprint_documents(spark.createDataFrame([(3, "the red fox jumps of the hill")], SCHEMA)).first()
    assert only.near_next == 1.0


# pipeline

def brute_near(texts, similarity):
    """The smallest ids of the components of all pairs whose sets of five-word shingles have the similarity."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else frozenset() for i, t in texts.items()}
    holders, root = collections.defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for g in s or [()]:
            holders[g].append(i)
    for i, s in sets.items():
        shared = collections.Counter(j for g in s or [()] for j in holders[g] if j < i)
        for j, n in shared.items():
            if not s or n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if root[i] == i}


def test_near_duplicates_by_similarity(spark, monkeypatch):
    """Chains of edited copies, a repeated passage that dominates different texts, empty and short texts, against brute force; blocks of one to many sets."""
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts, stock = {}, " ".join(rng.choices(vocab, k=40))
    for group in range(12):
        body = rng.choices(vocab, k=150)
        for _ in range(rng.randint(1, 14)):
            body = list(body)
            for k in rng.sample(range(150), rng.choice([1, 2, 3, 5, 8])):
                body[k] = rng.choice(vocab)
            texts[len(texts)] = " ".join(body)
    texts |= {1000 + i: " ".join([stock] * 12 + rng.choices(vocab, k=90)) for i in range(6)}  # alike by count, not as sets
    texts |= {2000: "", 2001: "   ", 2002: "two words", 2003: "Two  words", 2004: "one", 2005: texts[3], 2006: texts[3].upper()}
    frame = spark.createDataFrame([*texts.items()], SCHEMA)
    want = brute_near(texts, 0.8)
    for block in (8 << 20, 4000):
        monkeypatch.setattr(simhash, "SET_BLOCK", block)
        got = simhash.near_duplicates(frame, **pipeline.NEAR).collect()
        assert len(got) == len(texts) and {r.doc_id for r in got if r.doc_id == r.component_id} == want
    nulls = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (None, None), (5, "")], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(nulls, **pipeline.NEAR).collect()} == {(None, None), (None, 5), (5, 5)}
    assert simhash.near_duplicates(empty(spark), **pipeline.NEAR).count() == 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "tokens":
            assert out.columns == columns
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0 OR toxic = 1").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
            decided = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
            assert set(after) == decided and len(bad & set(after)) <= 0.3 * len(bad) and len(good & set(after)) >= 0.97 * len(good)
        if name == "line_dedup":
            first = {}
            for i, r in before.items():
                for x in r.text.split("\n"):
                    key = x.strip(" \t\n\x0b\x0c\r").translate(LOW)
                    if len(key) >= 10:
                        first[key] = min(i, first.get(key, i))
            for i, r in before.items():
                kept = "\n".join(x for x in r.text.split("\n") if first.get(x.strip(" \t\n\x0b\x0c\r").translate(LOW), i) >= i)
                assert after[i].text == kept and after[i].n_chars == len(kept)
        if name == "near_dedup":
            assert set(after) == brute_near({i: r.text for i, r in before.items()}, 0.8)
        if name == "decontamination":
            tok = lambda s: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", s.translate(LOW))) + " "
            items = [tok(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            holds = {i for i, r in before.items() if any(x in tok(r.text) for x in items)}
            assert not holds & set(after) and len(before) - len(after) <= len(holds) + 2
        if name == "tokens":
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after.values())
        docs = out
    assert pipeline.run(spark, sf).count() == len(after)

"""Alignment of two tokenizers against the libraries and a plain two-pointer walk over every document."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvex.llm import cross_align
from corvex.llm.bpe import byte_alphabet
from corvex.llm.queries import QUERIES
from tests.oracle import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [None, "", " ", "  ", "a  ", "  a", "\n\n x\t", "<|endoftext|> <s>x</s><unk> <0x41>", "a▁b", "naïve Ωmega 日本語テスト", "😀👩‍👩‍👧 ok", "x" * 3000, "ab " * 2000, "a\x00b", "don't   stop  ", "é é ﬁ ½", "a　b\xa0c", "▁"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, texts):
    """Every text on its own: ids by the libraries, ends as sets, links by overlapping ranges."""
    a_model, b_model = libraries
    back = {c: b for b, c in byte_alphabet().items()}
    rows, held = [], collections.Counter()
    for t in texts:
        a = a_model.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        raw_a = [bytes(back[c] for c in a_model.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            rows.append(([], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        shared = sorted(set(ends_a) & set(ends_b))
        groups, links, j = [], [], 0
        for e in shared:
            s = groups[-1][0] if groups else 0
            groups.append((e, [i for i, x in zip(a, ends_a) if s < x <= e], [i for i, x in zip(b, ends_b) if s < x <= e]))
        for i, e in enumerate(ends_a):
            s = e - len(raw_a[i])
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(raw_b[k]) < e:
                links.append((i, k))
                k += 1
        rows.append((a, b, groups, links))
        held.update({(a[i], b[k]) for i, k in links})
    most = collections.defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups, links in rows:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, x, y in groups)
        pairs = [(a[i], b[k]) for i, k in links]
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return out


def random_texts(n, seed=3):
    rng = random.Random(seed)
    signs = [" ", "  ", "\n", "the", "a", "ing", "é", "日", "́", "😀", "1", "23", "...", "'s", "\t", "Ω", " ", "zq", "Hello", "</s>", "\x7f"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_op11_brute_force(spark, libraries):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_alignment"](spark, SF).collect()}
    assert got == {r.doc_id: want for r, want in zip(rows, plain(libraries, [r.text for r in rows]))}


def test_op11_hostile(spark, libraries):
    texts = HARD + random_texts(400) + [" ".join(random_texts(300, 4))] + ["same text"] * 50
    docs = spark.createDataFrame([(i if i % 9 else None, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pack string").repartition(5)
    got = collections.Counter(tuple(r) for r in cross_align.link_statistics(docs, A, B).collect())
    assert got == collections.Counter((i if i % 9 else None, *want) for i, want in enumerate(plain(libraries, texts)))


def test_op11_pieces_equal_the_library(libraries):
    texts = [t or "" for t in HARD] + random_texts(3000, 7)
    own = cross_align.PieceBpe(B)
    assert own.apart and [x.tolist() for x in own.encode_all(texts)] == libraries[1].encode(texts)


def test_op11_real_outputs(spark, libraries):
    texts = [t for t in HARD if t] + random_texts(40, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in cross_align.align_documents(docs, A, B).collect():
        (n_a, n_b, n_groups, n_links, *_, digest), = plain(libraries, [r.text])
        assert (len(r.a_ids), len(r.b_ids), len(r.link_a)) == (n_a, n_b, n_links) and (not n_a or hashlib.sha256(r.groups.encode()).hexdigest() == digest)
        assert len(set(zip(r.link_a, r.link_b))) == n_links and all(0 <= i < n_a for i in r.link_a) and all(0 <= i < n_b for i in r.link_b)


def test_op11_lanes_and_blocks_change_nothing(monkeypatch):
    pair = cross_align.load(A, B)
    texts = [" ".join(random_texts(200, 11)), "x" * 5000, "", "日本" * 800, *random_texts(30, 12)]
    want = cross_align.Aligned(pair, texts)
    monkeypatch.setattr(cross_align, "BLOCK", 512)
    for lane in (1, 3, 1000):
        monkeypatch.setattr(cross_align, "LANE", lane)
        monkeypatch.setattr(cross_align.lanes, "__defaults__", (lane,))
        got = cross_align.Aligned(pair, texts)
        for name in ("cut_a", "cut_b", "n_links", "n_groups", "pairs", "held_by", "place", "times", "at"):
            assert np.array_equal(getattr(got, name), getattr(want, name)), (lane, name)


def test_op11_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cross_align.link_statistics(docs, A, B).count() == 0
    one = cross_align.link_statistics(docs.sparkSession.createDataFrame([(1, None)], docs.schema), A, B).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_op11_long_text(spark, libraries):
    text = "a long line of words, mixed 日本 and 1234 " * 60_000
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    (row,) = cross_align.link_statistics(docs, A, B).collect()
    assert row.n_groups > 0 and row.count_sum == row.n_links and len(text) > cross_align.SLICE

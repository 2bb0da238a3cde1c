"""SpotSigs: true likeness of sets of any sizes, long runs of common words, and near pairs against brute force."""

import random
import re

from pyspark.sql import functions as F

from corvex.llm import spotsigs

SCHEMA = "doc_id long, text string"


def plain_chains(text):
    words, out = re.findall(r"[^\W_]+", text.lower()), set()
    for i, w in enumerate(words):
        rest = [x for x in words[i + 1 :] if x not in spotsigs.COMMON][:2]
        if w in spotsigs.COMMON and len(rest) == 2:
            out.add(" ".join([w, *rest]))
    return out


def test_op10_signatures_against_plain_chains(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "la", "y", "theory", "fox", "ofen", "dog", "x"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["the " * 12 + "red fox", "of " * 900, "the red of", "fox the red"]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    hashes = {r.c: r.h for r in spark.createDataFrame([(c,) for c in sorted(set().union(*map(plain_chains, texts)))], "c string").select("c", F.xxhash64("c").alias("h")).collect()}
    got = {r.doc_id: r.s for r in frame.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = sorted(hashes[c] for c in plain_chains(t))
        assert got[i] == want if want else len(got[i]) == 1


def test_op10_likeness_of_unequal_sizes(spark):
    """One signature of 500 in common is a likeness of 0.002, not 0."""
    long = "the red fox " + " ".join(f"of w{i}" for i in range(500))
    rows = spotsigs.fingerprint_documents(spark.createDataFrame([(1, "the red fox"), (2, long)], SCHEMA)).collect()
    n = len(plain_chains(long))
    assert n > 400 and all(abs(r.near_next - 1 / n) < 1e-12 for r in rows)


def test_op10_near_pairs_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = [f"the w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(words))
            words = [w if rng.random() > 0.05 else "the new" for w in words][: len(words) - rng.randint(0, 2)]
    texts += [texts[0], texts[0], "no anchors", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    sets = {r.doc_id: frozenset(r.s) for r in frame.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    for least in (0.5, 0.8, 1.0):
        want = {(first[s], i): 1.0 for i, s in sets.items() if first[s] != i}
        for a in first.values():
            for b in first.values():
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if a < b and j >= least:
                    want[a, b] = j
        got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(frame, least).collect()}
        assert got == want


def test_op10_long_run_of_common_words(spark):
    frame = spark.createDataFrame([(1, "the " * 60_000 + "red fox"), (2, "of " * 60_000)], SCHEMA)
    one, two = (r.s for r in frame.orderBy("doc_id").select(spotsigs.signatures(F.col("text")).alias("s")).collect())
    assert one == [frame.select(F.xxhash64(F.lit("the red fox"))).first()[0]] and len(two) == 1

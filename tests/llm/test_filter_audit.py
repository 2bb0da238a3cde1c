"""The filter audit against SQL, and against filters applied one after the other."""

import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corvex.llm import filter_audit
from corvex.llm.queries import QUERIES, SQL
from tests.oracle import assert_matches, connect

LABELS = "doc_id long, quality int, toxic int, text string"


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang) rows. Every order run as a chain."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = collections.defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t],
        )) if bad)
        rows[lang or ""].append((fails, i in good, i in toxic))
    out, every = {}, list(itertools.permutations("ABCDE"))
    for part, found in rows.items():
        shapley = collections.Counter()
        for order in every:
            left = found
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                stay = [r for r in left if f not in r[0]]
                out[part, "".join(order), step] = [len(stay), len(gone), sum(f in r[0] for r in found) - len(gone), sum(r[0] == f for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[f] += len(gone)
                left = stay
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_op12_sql(spark):
    assert_matches(spark, connect(), QUERIES["op12_filter_audit"], SQL["op12_filter_audit"])


def test_op12_against_chains(spark):
    rng = random.Random(5)
    texts = [None, "", "a" * 40, "A B # " + "w " * 250, " ".join(f"w{i}" for i in range(300)), "X" + " ".join(f"w{i}" for i in range(200)), "same " * 300, "word " * 100_000 + "|", "\x0b\x0c \t", "É" * 50 + " ABC"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(400)]
    docs += [(i, "one text of a third of the table", "en") for i in range(100, 300)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, n int").repartition(7)
    known = spark.createDataFrame([(*r, "t") for r in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit_documents(df, known).collect()}
    assert got == plain_audit(docs, labels)


def test_op12_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], docs.schema)
    assert filter_audit.audit_documents(one, labels).where("kept = 0 AND filter_order LIKE 'A%'").count() == 24 * 5


def test_op12_removal_steps():
    orders = filter_audit.orders_of(4)
    masks = (np.arange(16)[:, None] >> np.arange(4)) & 1 == 1
    steps = filter_audit.removal_steps(masks, orders)
    for m, row in zip(masks, steps):
        for o, s in zip(orders, row):
            want = next((k for k, f in enumerate(o) if m[f]), None)
            assert s == (filter_audit.NEVER if want is None else want)


def test_op12_copies_are_counted_before_they_move(spark):
    docs = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([], LABELS)
    counts = {r["mask"]: r["documents"] for r in filter_audit.mask_counts(docs, labels).collect()}
    assert counts == {1: 1, 17: 19_999}

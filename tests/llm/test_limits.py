"""Texts and partitionings that once gave wrong results or stopped a job."""

import random
import unicodedata

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvex.llm import decontamination, pii_crf, quality, token_count, unicode_classes
from tests.oracle import SF

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_op9_long_runs_of_digits(spark):
    texts = ["0" * 5000 + ".1.2.3", "9" * 5000 + ".1.2.3", "1." + "0" * 1_000_000 + "7.2.3 x", "256.1.1.1", "000255.0.0.00"]
    assert [len([s for s in pii_crf.base_spans(t) if s[0] == 1]) for t in texts] == [1, 0, 1, 0, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: len([s for s in r.base_spans if s.kind == "ip"]) for r in pii_crf.find_personal_data(df).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}


def test_op4_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = [{(r.doc_id, r.score, r.weak_bad, r.keep) for r in quality.classify(docs.orderBy(F.xxhash64("doc_id", F.lit(n))).repartition(n), labels).collect()} for n in (1, 7)]
    assert got[0] == got[1]


def test_op5_composes_like_the_library(spark):
    library, counter, rng = Tokenizer.from_file(WORD), token_count.load(WORD), random.Random(2)
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))] + np.flatnonzero(unicode_classes.composition_differs()).tolist()
    texts = [a + chr(m) + chr(n) for a in "aé" for m in marks for n in rng.sample(marks, 12)]
    texts += ["".join(chr(rng.choice(marks)) if rng.random() < 0.6 else rng.choice("aeiXÅê日가 ") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op2_gate_grows_with_the_seeds():
    for n in (1, 4096, 100_000, 1_000_000):
        assert decontamination.gate_size(n) >= 8 * n or decontamination.gate_size(n) == 1 << 24
    assert decontamination.gate_size(2_000_000) == 1 << 24

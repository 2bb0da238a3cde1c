"""Quality classifier from weak labels.

Overlapping heuristic labellers vote "bad", "good" or abstain on every document; expectation-maximisation (Dawid and
Skene's model with abstention as an outcome of its own) estimates how accurate each is from the counts of vote patterns
over the whole corpus, and gives every pattern a posterior. The posteriors label the training rows of a hashed linear
scorer, which reads the words and the votes of the heuristics. Human labels are one labeller of the fit; no document is
judged by its own label: the scorer and the posterior of the heuristics alone decide.

Fitting reads bounded samples: LABELLED labelled rows for the lexicon of toxic words, TRAINED rows for the scorer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.common import cut, slices, text_of
from corvex.llm.vec import U, Words, mix, prefix_sums, span_hashes

LABELLED, TRAINED, BUCKETS = 40_000, 40_000, 1 << 18
PREFIXES = (4, 5)
#: A document has toxic words if at least this share of its words is in the lexicon, of which one at least as a whole word
#: or two by their beginnings; or if it holds so many different words of the lexicon, however long it is.
TOXIC_SHARE, TOXIC_DISTINCT = 0.008, 3
ABSTAIN, GOOD, BAD = 0, 1, 2
#: The labellers, in the order of the digits of a vote pattern; the last is the human label.
LABELLERS = ("signs", "capitals", "repetition", "separators", "toxic words", "plain prose", "human")
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#$%&*|~^<>={}\\_@!"]] = True
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 for b in range(256)])
_EDGE = np.array([33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)])


def stem_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII signs at their ends (a word of signs alone keeps one), and of their beginnings (PREFIXES, bytes) in rows; 0 where a word is no longer than that."""
    start, end = words.starts.copy(), words.ends.copy()
    for _ in range(6):
        start += _EDGE[words.bytes[start]] & (start < end - 1)
        end -= _EDGE[words.bytes[end - 1]] & (start < end - 1)
    sums = prefix_sums(words.bytes)
    begin = [np.where(end - start > k, mix(span_hashes(sums, start, np.minimum(start + k, end)) + U(k)), U(0)) for k in PREFIXES]
    return span_hashes(sums, start, end), np.stack(begin)


def votes(words: Words, raw: np.ndarray, stems: np.ndarray, begin: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Votes (documents, six heuristics). Each heuristic judges one thing and abstains where that is not clear."""
    n, count = len(words.counts), np.maximum(words.counts, 1)
    per_doc = lambda of_word: np.bincount(words.doc, of_word, n) / count
    signed = _SIGN[raw[words.ends - 1]]
    out = np.zeros((n, 6), np.int8)
    out[:, 0] = np.where(per_doc(signed) > 0.3, BAD, ABSTAIN)
    edges = np.append(words.firsts, len(raw))
    upper, letters = (np.diff(np.concatenate(([0], np.cumsum(table[raw])))[edges]) for table in (_UPPER, _LETTER))
    out[:, 1] = np.where(upper > 0.5 * np.maximum(letters, 1), BAD, ABSTAIN)
    # three words in a row that stood in the document before
    if len(words.hashes) >= 3:
        inside = words.doc[2:] == words.doc[:-2]
        three = mix(words.hashes[:-2] * U(3) + mix(words.hashes[1:-1] * U(5) + words.hashes[2:]))[inside]
        own = words.doc[2:][inside]
        distinct = np.bincount(own[np.unique(mix(three + own.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1]], minlength=n)
        total = np.bincount(own, minlength=n)
        fresh = distinct / np.maximum(total, 1)
        out[:, 2] = np.where((total > 20) & (fresh < 0.6), BAD, ABSTAIN)
        twice = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
        out[(np.bincount(words.doc[1:], twice, n) > 0.3 * words.counts) & (words.counts >= 6), 2] = BAD
    single = (words.ends - words.starts == 1) & signed
    out[:, 3] = np.where(per_doc(single) > 0.1, BAD, ABSTAIN)
    found = np.zeros((2, len(stems)), bool)  # as whole words, by their beginnings
    if len(toxic):
        for row, own in zip((0, *[1] * len(begin)), (stems, *begin)):
            found[row] |= toxic[np.minimum(np.searchsorted(toxic, own), len(toxic) - 1)] == own
    hits, whole = (np.bincount(words.doc, x, n) for x in (found.any(0), found[0]))
    _, first = np.unique(mix(stems[found[0]] + words.doc[found[0]].astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(words.doc[found[0]][first], minlength=n)
    out[:, 4] = np.where(((hits >= TOXIC_SHARE * count) & ((whole > 0) | (hits > 1))) | (distinct >= TOXIC_DISTINCT), BAD, ABSTAIN)
    out[:, 5] = np.where((out[:, :5] == ABSTAIN).all(1) & (per_doc(signed) < 0.05), GOOD, ABSTAIN)
    return out


def _read(texts: list[bytes], toxic: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(texts)
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    stems, begin = stem_hashes(words)
    return words, stems, votes(words, raw, stems, begin, toxic)


def toxic_words(labelled: DataFrame, least: int = 4, rate: float = 0.004, odds: float = 20.0) -> np.ndarray:
    """Sorted hashes of words and word beginnings at `odds` times the rate of the other documents in toxic ones.

    In toxic documents a word counts as often as documents hold it, but once at most for each different word before it, so
    that copies of one text count once; it has to reach `least` and `rate` of the number of toxic rows. These are at most as many as the words of an
    average toxic row, divided by the rate. labelled: text and toxic (not null) of at most LABELLED rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False) > 0
            words = Words(texts)
            stems, begin = stem_hashes(words)
            before = np.concatenate(([U(0)], words.hashes[:-1])) if len(stems) else stems
            before[words.offsets[:-1][words.counts > 0]] = 0  # no word stands before a text's first
            for every in (stems, *begin):
                known, bad = np.flatnonzero(every != 0), np.flatnonzero((every != 0) & toxic[words.doc])
                _, first = np.unique(mix(every[known] + words.doc[known].astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
                word, of = np.unique(every[known][first], return_inverse=True)
                held = np.bincount(of, toxic[words.doc[known][first]], len(word)).astype(np.int64)
                pair, at = np.unique(mix(every[bad] * U(3) + before[bad]), return_index=True)
                none = np.zeros(len(pair), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([word, every[bad][at]]).view(np.int64)), pa.array(np.concatenate([np.zeros(len(word), U), pair]).view(np.int64)),
                     pa.array(np.concatenate([np.bincount(of, minlength=len(word)) - held, none])), pa.array(np.concatenate([held, none]))],
                    ["word", "context", "good", "held"])

    rows = labelled.agg(F.sum((F.col("toxic") > 0).cast("long")), F.count("*")).head()
    bad_rows, good_rows = (rows[0] or 0) + 1, rows[1] - (rows[0] or 0) + 1
    pairs = labelled.mapInArrow(count, "word long, context long, good long, held long").groupBy("word", "context").agg(F.sum("good").alias("good"), F.sum("held").alias("held"))
    found = pairs.groupBy("word").agg(F.least(F.count_if(F.col("context") != 0), F.sum("held")).alias("bad"), F.sum("good").alias("good"))
    score = (F.col("bad") / bad_rows) / ((F.col("good") + 0.5) / good_rows)
    best = found.where(F.col("bad") >= max(least, rate * bad_rows)).where(score >= odds).select("word").collect()
    return np.sort(np.array([r["word"] for r in best], np.int64).view(U))


def posterior(patterns: np.ndarray, prior: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The probability of "bad" given the votes (pattern, labeller) of as many labellers as the patterns have."""
    score = np.einsum("plv,lcv->pc", np.eye(3)[patterns], np.log(table[: patterns.shape[1]])) + np.log(prior)
    return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dawid and Skene's EM over vote patterns: the posterior of "bad" of each pattern, the prior of (good, bad), and P(vote | class) as (labeller, class, vote).

    The start is the majority of the votes; human labels count threefold there.
    """
    if not len(patterns):
        return np.zeros(0), np.full(2, 0.5), np.full((patterns.shape[1], 2, 3), 1 / 3)
    weight = np.ones(patterns.shape[1])
    weight[-1] = 3
    lean = ((patterns == BAD) * weight).sum(1) - ((patterns == GOOD) * weight).sum(1)
    bad = np.where(lean > 0, 0.95, np.where(lean < 0, 0.05, 0.5))
    one = np.eye(3)[patterns]  # (pattern, labeller, vote)
    for _ in range(rounds):
        share = np.stack([counts * (1 - bad), counts * bad])
        prior = (share.sum(1) + 1) / (counts.sum() + 2)
        table = np.einsum("cp,plv->lcv", share, one) + 0.5
        table /= table.sum(2, keepdims=True)
        bad = posterior(patterns, prior, table)
    return bad, prior, table


def _features(words: Words, stems: np.ndarray, cast: np.ndarray, i: int) -> np.ndarray:
    """Buckets of the distinct words of document i and of its votes; the first bucket is the constant."""
    own = np.unique(stems[words.offsets[i] : words.offsets[i + 1]] % U(BUCKETS - 16)).astype(np.int64) + 16
    return np.concatenate(([0], 1 + np.flatnonzero(cast[i] != ABSTAIN), own))


def train(rows: DataFrame, toxic: np.ndarray, shards: int = 4, rounds: int = 4) -> np.ndarray:
    """Weights of the scorer: AdaGrad on the logistic loss of the posteriors in each shard, averaged over the shards that saw a bucket.

    rows: text and bad (the posterior) of at most TRAINED rows.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, goals = [], []
        for batch, texts in slices(batches, "text"):
            goals += batch.column(batch.schema.get_field_index("bad")).to_pylist()
            words, stems, cast = _read(texts, toxic)
            examples += [_features(words, stems, cast, i).astype(np.int32) for i in range(len(texts))]
        w, g = np.zeros(BUCKETS), np.full(BUCKETS, 1.0)
        rng = np.random.default_rng(1)
        for _ in range(rounds):
            for i in rng.permutation(len(examples)):
                x = examples[i]
                step = 1 / (1 + np.exp(-np.clip(w[x].sum(), -30, 30))) - goals[i]
                g[x] += step * step
                w[x] -= 0.5 * step / np.sqrt(g[x])
        seen = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(w[seen])], ["bucket", "w"])

    # a shard's rows and the shards' weights in an order of their own, so that the fit is the same however the input is dealt
    number = F.xxhash64("doc_id", "text")
    found = rows.repartition(shards, number).sortWithinPartitions(number, "doc_id", "text").mapInArrow(fit, "bucket long, w double").groupBy("bucket").agg(F.array_sort(F.collect_list("w")).alias("w"))
    weights = np.zeros(BUCKETS)
    for r in found.toLocalIterator():
        weights[r["bucket"]] = sum(r["w"]) / len(r["w"])
    return weights


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, labelled: int = LABELLED, trained: int = TRAINED) -> DataFrame:
    """doc_id, score (the scorer's probability of "bad"), weak_bad (the posterior of the heuristics' votes) and keep: whether
    both are under threshold.

    labels: doc_id, quality and toxic (0 or 1). A label says bad if one of its values does, good if both are known and good,
    else nothing; several rows of one document say bad if one does. Null and empty texts draw no votes and are judged like
    any other. Without labels the heuristics alone decide. Rows without an id are scored like others and are no part of the
    fit's training rows; repeated ids are rows of their own, which share a label. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    vote_of = F.when((F.col("toxic") > 0) | (F.col("quality") < 1), BAD).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), GOOD).otherwise(ABSTAIN)
    human = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(vote_of).alias("human"), F.max("toxic").alias("toxic"))
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    known = human.where("toxic IS NOT NULL")
    n_labels = max(1, known.count())
    part = lambda n, most: F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / n))
    lexicon = toxic_words(known.where(part(n_labels, labelled)).join(own.where(part(n_labels, labelled)), "doc_id").select("text", "toxic"))
    sent = spark.sparkContext.broadcast(lexicon)
    id_type = own.schema["doc_id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            _, _, cast = _read(texts, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((cast * 3 ** np.arange(6)).sum(1).astype(np.int64))], ["doc_id", "heuristic"])

    cast = own.mapInArrow(vote, f"doc_id {id_type}, heuristic long").join(human.select("doc_id", "human"), "doc_id", "left")
    cast = cut(cast.select("doc_id", (F.col("heuristic") + F.coalesce("human", F.lit(ABSTAIN)) * 3**6).alias("pattern")), "votes")
    seen = cast.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3**7 patterns
    digits = lambda codes, n: codes[:, None] // 3 ** np.arange(n) % 3
    codes = np.array([r["pattern"] for r in seen], np.int64)
    bad, prior, table = estimate(digits(codes, 7), np.array([r["count"] for r in seen], float))
    goal = spark.createDataFrame([(int(c), float(b)) for c, b in zip(codes, bad)], "pattern long, bad double")
    n = max(1, sum(r["count"] for r in seen))
    goals = cast.where(part(n, trained)).where("doc_id IS NOT NULL").join(F.broadcast(goal), "pattern").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    weights = train(goals.join(own.where(part(n, trained)), "doc_id").select("doc_id", "text", "bad"), lexicon)
    weak = posterior(digits(np.arange(3**6), 6), prior, table)
    scorer = spark.sparkContext.broadcast((weights, lexicon, weak))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, lexicon, weak = scorer.value
        for batch, texts in slices(batches, "text"):
            words, stems, cast = _read(texts, lexicon)
            bucket = (stems % U(BUCKETS - 16)).astype(np.int64) + 16
            _, first = np.unique(words.doc * BUCKETS + bucket, return_index=True)  # distinct buckets of each document
            total = np.bincount(words.doc[first], weights[bucket[first]], len(texts)) + weights[0] + ((cast != ABSTAIN) * weights[1:7]).sum(1)
            value = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            weak_bad = weak[(cast * 3 ** np.arange(6)).sum(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array(weak_bad), pa.array((value < threshold) & (weak_bad < threshold))], ["doc_id", "score", "weak_bad", "keep"])

    return own.mapInArrow(score, f"doc_id {id_type}, score double, weak_bad double, keep boolean")

"""Document fingerprints by SpotSigs, with DataFrame functions alone.

A signature is a common word (the anchor) with the chain of content words that follow it, common words between them
skipped. A document's fingerprint is the set of its signatures. Two fingerprints are compared by the Jaccard measure,
which their sizes bound from above: near_pairs joins sets of the same and of neighbouring length partitions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvex.llm.common import cut, text_of

# Frequent function words of English, French, German and Spanish.
COMMON = """the of and to in a is that was it for on be with as by this are at from or an
la le les des du et un une que qui en pour dans est sur pas au par
der die das und den von zu mit sich ist auf ein eine dem nicht im es
el los las del y se por con para su al lo no""".split()
CHAIN, DOCUMENTS_PER_BUCKET, MOST_BUCKETS = 2, 256, 10_000


def _any_of(words: list[str]) -> str:
    """A pattern for exactly these words, branching on one letter at a time, so that a word is tried against few branches."""
    heads = sorted({w[0] for w in words if w})
    if not heads:
        return ""
    parts = [h + _any_of([w[1:] for w in words if w.startswith(h)]) for h in heads]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{body})?" if "" in words else body


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signature hashes of a text; one that has none is its own signature as a whole."""
    common = _any_of(COMMON) + "(?= )"
    run = f"(?: {common})++"  # all common words in a row are read once, and share the chain behind them
    step = f"(?:{run})?+ [^ ]+"
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    found = F.regexp_extract_all(plain, F.lit(f"(?=({run}(?:{step * chain}(?= ))?)){run}"), F.lit(1))
    anchors = lambda x: F.array_distinct(F.split(F.ltrim(F.regexp_extract(x, run, 0)), " "))
    content = lambda x: F.regexp_replace(x, f" {common}", "")
    each = F.transform(found, lambda x: F.struct(F.concat(x, F.lit(" ")).alias("x")))
    each = F.transform(each, lambda y: F.struct(anchors(y["x"]).alias("anchors"), F.rtrim(content(y["x"])).alias("content")))
    hashed = F.flatten(F.transform(F.filter(each, lambda y: y["content"] != ""), lambda y: F.transform(y["anchors"], lambda w: F.xxhash64(F.concat(w, y["content"])))))
    return F.when(F.size(hashed) > 0, F.array_sort(F.array_distinct(hashed))).otherwise(F.array(F.xxhash64(text)))


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(F.transform(signature_set, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """The Jaccard measure of two signature sets; 0 where their sizes show that it is below `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small < large * F.lit(least), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _bounds(docs: DataFrame) -> list[int]:
    """Ascending ids, the smallest first, that cut the documents into buckets of about DOCUMENTS_PER_BUCKET (at most MOST_BUCKETS)."""
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // DOCUMENTS_PER_BUCKET))
    row = docs.agg(F.min("doc_id").alias("first"), F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 20 * buckets).alias("cuts")).head()
    return sorted({row["first"], *row["cuts"]}) if row["first"] is not None else [0]


def _bucket(doc_id: Column, bounds: list[int], group: int = 100) -> Column:
    """The number of the last bound that is not above doc_id, by a two-level search; 0 for no id."""
    at_most = lambda values: F.coalesce(F.size(F.filter(values, lambda b: b <= doc_id)), F.lit(0))
    whole = F.array(*map(F.lit, bounds))
    coarse = F.greatest(at_most(F.array(*map(F.lit, bounds[::group]))) - 1, F.lit(0)) if len(bounds) > group else F.lit(0)
    return F.greatest(coarse * group + at_most(F.slice(whole, coarse * group + 1, F.lit(group))) - 1, F.lit(0))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) with next_<column> of the following row by doc_id, then text; after the last comes the first.

    One shuffle: rows are dealt by id range, and the row at a range's lower bound is copied to the range before it. Rows
    without an id come first and follow nothing.
    """
    bounds = _bounds(docs)
    bucket = _bucket(F.col("doc_id"), bounds)
    at_bound = F.array_contains(F.array(*map(F.lit, bounds)), F.col("doc_id"))
    copies = F.when(at_bound, F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guard")), F.struct(F.pmod(bucket - 1, F.lit(len(bounds))).alias("bucket"), F.lit(True).alias("guard"))))
    dealt = docs.withColumn("__to", F.explode(copies.otherwise(F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guard"))))))
    order = Window.partitionBy("__to.bucket").orderBy("__to.guard", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("NOT __to.guard").drop("__to")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The fingerprint of each text and of its edited text, whose last half comes from the start of the next document.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next. A null text is the
    empty text; equal texts have equal fingerprints; an only document is its own next. Likeness below `least` by the
    size bound is 0. Repeated ids are separate rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    ready = with_next(own.withColumn("sigs", signatures(F.col("text"))), ["text", "sigs"]).withColumn("edited_text", edited)
    ready = ready.withColumn("edited_sigs", signatures(F.col("edited_text")))
    return ready.select(
        "doc_id", n.cast("long").alias("n_chars"), "edited_text", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs"), least).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs"), least).alias("near_next"),
    )


def near_pairs(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) with a likeness of at least `least` (above 0), a < b or both alike; none is missed.

    Sets that are equal count once: each further document of a set makes one pair with the set's smallest id, which stands
    for the set in all other pairs. Sets meet where they share one of their rarest signatures (of n the first
    n - ceil(least * n) + 1) in the same or a neighbouring length partition, and are compared as a whole then.
    """
    width = -math.log(least) + 1e-9
    own = docs.select(F.col(id_col).alias("doc_id"), signatures(text_of(text_col)).alias("sigs")).where("doc_id IS NOT NULL")
    own = cut(own.withColumn("key", F.xxhash64("sigs")), "signatures")
    sets = cut(own.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")), "sets")
    single = sets.select("key", "n", F.explode("sigs").alias("sig"))
    ranked = single.join(single.groupBy("sig").agg(F.count("*").alias("held")), "sig")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("held", "sig")))
    rare = cut(ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("key", "n", "sig", F.floor(F.log("n") / width).alias("length")), "rare")
    small = rare.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "sig", "length")
    large = rare.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "sig", F.explode(F.array("length", F.col("length") - 1)).alias("length"))
    met = small.join(large, ["sig", "length"]).where((F.col("n_a") >= F.col("n_b") * least - 1e-9) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))))
    side = lambda k: sets.select(F.col("key").alias(k), F.col("first").alias(f"first_{k}"), F.col("sigs").alias(f"sigs_{k}"))
    pairs = met.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b")))
    pairs = pairs.where(F.col("likeness") >= least - 1e-9).select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"), "likeness")
    same = own.select("key", "doc_id").join(sets.select("key", "first"), "key").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness"))
    return pairs.unionByName(same)

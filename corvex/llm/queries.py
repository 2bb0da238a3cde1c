"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.line_dedup import dedup_lines

    return dedup_lines(_docs(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.decontamination import find_overlaps

    return find_overlaps(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.bpe import digest_documents

    return digest_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.quality import classify

    return classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.token_count import count_tokens

    return count_tokens(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.simhash import near_duplicates

    found = near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.suffix_dedup import remove_repeats

    return remove_repeats(_docs(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.pitman_yor import score_documents

    return score_documents(_docs(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.pii_crf import KINDS, find_personal_data

    found = find_personal_data(_docs(spark, sf_dir))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.spotsigs import fingerprint_documents

    found = fingerprint_documents(_docs(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.cross_align import link_statistics

    return link_statistics(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.filter_audit import audit_documents

    return audit_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvex.llm.rotated_codes import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_decontamination": op2_decontamination, "op3_bpe": op3_bpe, "op4_quality": op4_quality, "op5_token_counts": op5_token_counts, "op6_simhash": op6_simhash, "op7_suffix_dedup": op7_suffix_dedup, "op8_language_model": op8_language_model, "op9_personal_data": op9_personal_data, "op10_fingerprints": op10_fingerprints, "op11_alignment": op11_alignment, "op12_filter_audit": op12_filter_audit, "op13_nearest": op13_nearest}

_STRIP = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
SQL = {
    "op1_line_dedup": rf"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '{_STRIP}', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
first AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone FROM keyed k LEFT JOIN first f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op12_filter_audit": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tests AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM split),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, list_filter([if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')], lambda x: x <> '') AS fails, count(*) AS n,
    coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM tests LEFT JOIN known USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT '' AS o
  UNION ALL
  SELECT o || l FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS x(l) WHERE position(l IN o) = 0),
steps AS (SELECT o AS filter_order, s AS step, substr(o, s, 1) AS letter FROM orders, unnest([1, 2, 3, 4, 5]) AS y(s) WHERE length(o) = 5),
counted AS (
  SELECT part, filter_order, step, letter,
    sum(n) FILTER (coalesce(list_min(list_transform(fails, lambda f: position(f IN filter_order))), 9) > step) AS kept,
    sum(n) FILTER (list_min(list_transform(fails, lambda f: position(f IN filter_order))) = step) AS removed,
    sum(n) FILTER (list_contains(fails, letter) AND list_min(list_transform(fails, lambda f: position(f IN filter_order))) < step) AS redundant,
    sum(n) FILTER (fails = [letter]) AS unique_fails,
    sum(good) FILTER (list_min(list_transform(fails, lambda f: position(f IN filter_order))) = step) AS good_lost,
    sum(toxic) FILTER (list_min(list_transform(fails, lambda f: position(f IN filter_order))) = step) AS toxic_lost
  FROM failed, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM counted""",
}

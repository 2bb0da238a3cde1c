"""Retrieval and answer metrics, run comparison, structure audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.functions.text import WS


def recall_at(required: Column, predicted: Column, k: int, total: Column | None = None) -> Column:
    """Share of the required ids among the first k predictions; 1 where nothing is required.

    total: how many ids are required, where `required` holds those among the predictions alone.
    """
    hits = F.size(F.array_intersect(required, F.slice(predicted, 1, k)))
    total = F.size(F.array_distinct(required)) if total is None else total
    return F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(hits, total))


def precision_at(required: Column, predicted: Column, k: int) -> Column:
    """Required ids (each once) over the length of the window; 0 for an empty one."""
    window = F.slice(predicted, 1, k)
    return F.when(F.size(window) == 0, F.lit(0.0)).otherwise(F.try_divide(F.size(F.array_intersect(required, window)), F.size(window)))


def reciprocal_rank(required: Column, predicted: Column) -> Column:
    at = F.array_min(F.filter(F.transform(predicted, lambda p, i: F.when(F.array_contains(required, p), i + 1)), lambda i: i.isNotNull()))
    return F.coalesce(1.0 / at, F.lit(0.0))


def citation_correct(answer: Column, n_sources: Column) -> Column:
    """1 if any source 1..n is cited; without sources, 1 if none is."""
    cited = F.exists(F.sequence(F.lit(1), F.greatest(n_sources, F.lit(1))), lambda i: F.contains(answer, F.concat(F.lit("[source:"), i.cast("string"), F.lit("]"))))
    return F.when(n_sources == 0, (~F.contains(answer, F.lit("[source:"))).cast("double")).otherwise(cited.cast("double"))


def groundedness(answer: Column, sources: Column) -> Column:
    """Share of the answer's words of over three characters that a source holds."""
    words = lambda t: F.array_distinct(F.transform(F.filter(F.split(t, WS + "+"), lambda w: F.char_length(w) > 3), F.lower))
    own, theirs = words(answer), words(F.array_join(sources, " "))
    return (
        F.when(F.size(sources) == 0, F.contains(answer, F.lit("No accessible sources")).cast("double")).when(F.size(own) == 0, F.lit(0.0))
        .otherwise(F.try_divide(F.size(F.array_intersect(own, theirs)), F.size(own)))
    )


def top_hit(sections: Column, pages: Column, expected_sections: Column, expected_pages: Column, k: int) -> Column:
    """Whether a source among the first k has an expected section or page: false without sources, null without expectations."""
    hit = F.arrays_overlap(F.transform(F.slice(sections, 1, k), F.lower), F.transform(expected_sections, F.lower)) | F.arrays_overlap(F.slice(pages, 1, k), expected_pages)
    return F.when(F.size(sections) == 0, F.lit(False)).when((F.size(expected_sections) == 0) & (F.size(expected_pages) == 0), F.lit(None)).otherwise(hit)


def truth_rate(value: Column) -> Column:
    """Aggregate: the share of true among known values, 4 decimals, 0 for none."""
    return F.coalesce(F.round(F.avg(value.cast("double")), 4), F.lit(0.0))


def score_average(value: Column) -> Column:
    """Aggregate: the average of what reads as a number."""
    return F.coalesce(F.round(F.avg(F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")), 4), F.lit(0.0))


def nearest_rank(values: Column, share: float) -> Column:
    """Aggregate over a bounded group: the value at index round((n - 1) * share), halves to even."""
    ordered = F.sort_array(F.collect_list(values))
    return F.coalesce(F.get(ordered, F.bround((F.size(ordered) - 1) * F.lit(share)).cast("int")), F.lit(0.0))


def compare_runs(baseline: DataFrame, candidate: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of both runs side by side for questions that both have."""
    left = baseline.select(key, *(F.col(c).alias(f"baseline_{c}") for c in columns))
    return left.join(candidate.select(key, *(F.col(c).alias(f"candidate_{c}") for c in columns)), key)


def kind_histogram(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(F.coalesce(*columns, F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


def suspicious_heading(text: Column) -> Column:
    """Short capitalised lines, bracketed numbers and all-capital titles that are no numbered heading or label."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    words = F.filter(F.split(t, WS + "+"), lambda w: w != "")
    few, upper = F.size(words) <= 3, t == F.upper(t)
    return (
        F.when(t == "", False).when(t == "Abstract", False).when(t == "Transactions", True)
        .when(F.rlike(t, F.lit(r"^(?:[IVXLCM]+\.|\d+\.)")) | F.rlike(t, F.lit(r"^[A-Z]\.\s+")) | F.rlike(t, F.lit(r"^(?:Table|TABLE|Fig\.|Figure|Algorithm)\b")), False)
        .when(F.rlike(t, F.lit(r"^\[[0-9]+\]\s+")), True).when(few & upper & ~F.contains(t, F.lit(" ")), True)
        .when(few & F.forall(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}"))), True).when(F.startswith(t, F.lit("SUMMARY OF")) | (F.contains(t, F.lit("OF")) & upper), True).otherwise(False)
    )


def run_record(question: Column, expected: Column, answer: Column, sections: Column, pages: Column, chunk_ids: Column, top1: Column, top3: Column, latency: Column, tokens: tuple[Column, Column], cost: Column, error: Column) -> Column:
    """The record of a question's run as one struct; with an error that of a run that found nothing, cost nothing and names the error."""
    failed = error.isNotNull()
    empty = lambda c, kind: F.when(failed | c.isNull(), F.array().cast(f"array<{kind}>")).otherwise(c)
    number = lambda c: F.when(failed, F.lit(0)).otherwise(F.coalesce(c, F.lit(0)))
    taken, made = map(number, tokens)
    retrieval = F.struct(
        F.when(~failed, top1).alias("top1_hit"), F.when(~failed, top3).alias("top3_hit"), empty(sections, "string").alias("retrieved_sections"), empty(pages, "int").alias("retrieved_pages"),
        empty(chunk_ids, "bigint").alias("retrieved_chunk_ids"), F.lit("").alias("retrieval_notes"))
    usage = F.struct(taken.alias("input_tokens"), made.alias("output_tokens"), (taken + made).alias("total_tokens"), F.when(failed, F.lit(0.0)).otherwise(F.coalesce(cost, F.lit(0.0))).alias("estimated_cost_usd"))
    return F.struct(question.alias("question"), expected.alias("should_be_answerable"), retrieval.alias("retrieval"), F.when(failed, F.lit("")).otherwise(F.coalesce(answer, F.lit(""))).alias("answer"), number(latency).alias("latency_ms"), usage.alias("usage"), error.alias("error"))

"""Features, class and strategy of a question, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.functions.text import one_of

# The phrases that show what a question asks for.
PHRASES = {
    "compare": ("compare", "versus", "vs", "difference", "both", "whereas"),
    "summary": ("summarize", "summary", "overview"),
    "conclusion": ("conclusion", "real challenge", "main challenge"),
    "why": ("why", "reason", "drivers", "cause"),
    "unanswerable": ("ceo", "salary", "approved", "quarterly revenue"),
    "table": ("table", "metric", "mae", "r2", "value", "values", "accuracy"),
    "equation": ("equation", "formula", "variable", "compute", "calculation"),
    "algorithm": ("algorithm", "step", "procedure", "workflow"),
    "figure": ("figure", "fig.", "fig "),
}
SECTION_TERMS = ("summary", "conclusion", "phase", "risk", "governance", "support", "training", "table", "figure", "algorithm", "equation")
NUMERIC_PHRASES = ("how many", "what reporting period", "which training program", "what happened")
NUMBER = r"\b\d+(?:[.,]\d+)?\b"
DATE = r"\b(?:q[1-4]\s+\d{4}|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
QUOTED = "['\"]([^'\"]{3,})['\"]"
CLASSES = ("unsupported_probe", "conclusion", "summary", "compare", "why", "numeric_detail", "fact")
SUPPORTED = ("summary", "compare", "why", "conclusion")


def query_features(question: Column) -> dict[str, Column]:
    """Flags by substring (not by word), the section terms that occur, and the quoted phrase."""
    low = F.lower(question)
    out = {f"has_{name}": one_of(low, phrases) for name, phrases in PHRASES.items()}
    out["has_number"] = F.rlike(question, F.lit(NUMBER))
    out["has_date"] = F.rlike(low, F.lit(DATE))
    out["section_terms"] = F.filter(F.array(*map(F.lit, SECTION_TERMS)), lambda t: F.contains(low, t))
    out["quoted_phrase"] = F.when(F.rlike(question, F.lit(QUOTED)), F.lower(F.regexp_extract(question, QUOTED, 1)))
    return out


def feature_struct(question: Column) -> Column:
    """The features as one struct, to be computed once for each question and then read."""
    return F.struct(*(c.alias(n) for n, c in query_features(question).items()))


def query_class(question: Column, f: Column | dict[str, Column]) -> Column:
    """The first class whose signs the question (with features f) shows."""
    low = F.lower(question)
    numeric = f["has_number"] | f["has_date"] | f["has_table"] | f["has_equation"] | one_of(low, NUMERIC_PHRASES)
    return (
        F.when(f["has_unanswerable"], "unsupported_probe").when(f["has_conclusion"], "conclusion").when(f["has_summary"], "summary")
        .when(f["has_compare"], "compare").when(f["has_why"], "why").when(numeric, "numeric_detail").otherwise("fact")
    )


def strategy(question: Column, f: Column, c: Column, top_k: int = 5, per_document: int = 2, budget: int = 2200, vector_weight: float = 1.0, fts_weight: float = 0.85) -> Column:
    """What the class c of a question with features f changes: weights, limits, diversity, rewriting."""
    exact, dated = c.isin("fact", "numeric_detail"), f["has_number"] | f["has_date"]
    structured = f["has_table"] | f["has_equation"] | f["has_algorithm"]
    weight = F.when(c == "fact", 0.95).when(c == "numeric_detail", 0.85).when(c == "summary", 1.0).when(c.isin("why", "conclusion"), 1.05).otherwise(vector_weight)
    lexical = F.when(exact, F.when(dated, 1.1).otherwise(1.0) + F.when(structured, 0.15).otherwise(0.0)).when(c == "summary", 0.75).when(c.isin("why", "conclusion"), 0.8).otherwise(fts_weight)
    return F.struct(
        c.alias("query_class"), F.round(weight + F.when(F.contains(F.lower(question), F.lit("according to")), 0.05).otherwise(0.0), 4).alias("vector_weight"),
        F.round(lexical + F.when(F.size(f["section_terms"]) > 0, 0.1).otherwise(0.0), 4).alias("fts_weight"),
        F.when(exact, ~dated).when(c == "unsupported_probe", False).otherwise(True).alias("allow_rewrite"),
        F.when(exact | (c == "unsupported_probe"), F.lit(min(top_k, 2))).when(c.isin("summary", "compare"), F.lit(max(top_k, 3))).when(c.isin("why", "conclusion"), F.lit(max(top_k, 2))).otherwise(F.lit(top_k)).alias("top_k"),
        F.when(exact | (c == "unsupported_probe"), F.lit(1)).when(c == "summary", F.lit(max(per_document, 3))).when(c == "compare", F.lit(max(per_document, 2))).otherwise(F.lit(per_document)).alias("per_document"),
        F.when(c == "summary", F.lit(int(budget * 1.35))).otherwise(F.lit(budget)).alias("budget"),
        F.when(c.isin(*SUPPORTED), F.lit(2)).otherwise(F.lit(1)).alias("diversity"), c.isin(*SUPPORTED).alias("prefer_diversity"),
        F.when(c == "summary", F.lit(3)).when(c.isin("compare", "why", "conclusion"), F.lit(2)).otherwise(F.lit(0)).alias("min_new_terms"),
    )


def with_strategy(questions: DataFrame, column: str) -> DataFrame:
    """questions with columns f (features), query_class and s (strategy), each computed once and read by the next."""
    q = F.col(column)
    ready = questions.withColumn("f", feature_struct(q)).withColumn("query_class", query_class(q, F.col("f")))
    return ready.withColumn("s", strategy(q, F.col("f"), F.col("query_class")))

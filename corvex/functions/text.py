"""Scalar text functions: Column in, Column out; all but two inside the JVM."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Unicode white space as a character class that Java and RE2 read alike.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same signs for the JVM alone: one comparison sets printable ASCII aside, before the eleven ranges of WS are tried.
_SPACE = "[[^!-~]&&" + WS + "]"
_UNEVEN = "[[^ -~]&&" + WS + "]" + _SPACE + "*| " + _SPACE + "+"  # runs of white space that are not one blank already
#: Signs that are stripped from the ends of a term, function words that a query rewrite drops, key parts that mark a secret.
SIGNS = ".,!?;:-_()[]{}'\""
REWRITE_STOP_WORDS = ("a", "an", "and", "about", "does", "is", "say", "the", "what", "which", "who", "why", "how")
SECRET_KEYS = ("token", "secret", "password", "authorization", "api_key", "key")
EMAIL = r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
PHONE = r"\b(?:\+?\d[\d .()-]{7,}\d)\b"
TABLE_LABEL = r"(?i)^\s*(table\s+[ivxlcdm\d]+)\b"
FIGURE_LABEL = r"(?i)^\s*((?:fig(?:ure)?\.?)\s*\d+[a-z]?)\b"
ALGORITHM_LABEL = r"(?i)^\s*(algorithm\s+\d+[a-z]?)\b"
EQUATION_LABEL = r"^.+\((\d{1,3})\)\s*$"
NUMBERED_HEADING = r"^\s*(\d+(?:\.\d+)*)\.\s+(.+?)\s*$"
DECIMAL_HEADING = r"^\s*(\d+(?:\.\d+)+)\s+(.+?)\s*$"
ROMAN_HEADING = r"^\s*(?:[IVXLCM]+)\.\s+[A-Z][A-Z0-9\s:,\-()]+$"
LETTER_HEADING = r"^\s*[A-Z]\.\s+[A-Z].+$"
ABSTRACT_LEAD = r"(?i)^\s*abstract\s*[-:—]\s*(.+)$"
ALGORITHM_STEP = r"^\s*(?:step\s*\d+|input:|output:|require:|ensure:|\d+\)|\d+\.)"
EXPLANATION = ("where ", "denotes", "represents", "is the", "are the", "measures", "computes")
OPERATORS = "=+-*/^≤≥<>"


def one_of(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " "))


def is_blank(text: Column) -> Column:
    """Whether nothing is left of the text after normalize_whitespace; reads no further than the first other sign."""
    return ~F.rlike(F.coalesce(text, F.lit("")), F.lit("(?s)(?!" + _SPACE + ")."))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE + "+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Words, at least one."""
    return F.greatest(F.lit(1), F.size(words(text)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def strip_signs(word: Column) -> Column:
    return F.btrim(word, F.lit(SIGNS))


def terms(text: Column) -> Column:
    """Distinct lower-cased words of more than two characters, signs stripped, in the order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(words(text), lambda w: F.lower(strip_signs(w))), lambda w: F.char_length(w) > 2))


@F.pandas_udf(ArrayType(StringType()))
def ranked_terms(texts: pd.Series) -> pd.Series:
    """Terms by falling frequency, then first occurrence. Counting words in a higher-order function is quadratic, so this runs on Arrow batches."""

    def one(text: str | None) -> list[str]:
        counts = Counter(w for w in (t.strip(SIGNS).lower() for t in (text or "").split()) if len(w) > 2)
        return sorted(counts, key=lambda w: -counts[w])

    return texts.map(one)


@F.arrow_udf(StringType())
def vector_literal(vectors: pa.Array) -> pa.Array:
    """A vector as [a,b,...] with eight decimals of the exact value, halves to even; null components are left out. The JVM's format rounds halves up."""
    return pa.array([v if v is None else "[" + ",".join("%.8f" % x for x in v if x is not None) + "]" for v in vectors.to_pylist()], pa.string())


def preview(text: Column, length: int) -> Column:
    clean = normalize_whitespace(text)
    return F.when(F.char_length(clean) <= length, clean).otherwise(F.concat(F.left(clean, F.lit(length - 3)), F.lit("...")))


def redact_text(text: Column, length: int = 200) -> Column:
    """E-mail addresses and phone numbers replaced, then cut to length."""
    clean = F.regexp_replace(F.regexp_replace(text, EMAIL, "[redacted-email]"), PHONE, "[redacted-phone]")
    return F.when(F.char_length(clean) > length, F.concat(F.left(clean, F.lit(length)), F.lit("..."))).otherwise(clean)


def redact_value(key: Column, value: Column, length: int = 200) -> Column:
    """One entry of a flat payload: secrets by their key, other text by redact_text."""
    return F.when(one_of(F.lower(key), SECRET_KEYS), F.lit("[redacted-secret]")).otherwise(redact_text(value, length))


def redact_payload(payload: Column, length: int = 200) -> Column:
    """A map of texts, every entry redacted."""
    return F.transform_values(payload, lambda k, v: redact_value(k, v, length))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's match, null where the pattern does not match."""
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def is_structural_heading(text: Column) -> Column:
    clean = F.btrim(text)
    return F.rlike(clean, F.lit(NUMBERED_HEADING)) | F.rlike(clean, F.lit(ROMAN_HEADING))


def looks_like_heading(text: Column) -> Column:
    labels = F.rlike(text, F.lit(TABLE_LABEL)) | F.rlike(text, F.lit(FIGURE_LABEL)) | F.rlike(text, F.lit(ALGORITHM_LABEL))
    shapes = F.lit(False)
    for p in (NUMBERED_HEADING, DECIMAL_HEADING, ROMAN_HEADING, LETTER_HEADING):
        shapes = shapes | F.rlike(text, F.lit(p))
    return (F.char_length(text) > 0) & (F.char_length(text) <= 140) & ~labels & shapes


def heading_level(text: Column, nesting: Column) -> Column:
    """The level that a heading's number shows, at least its nesting level."""
    decimal = F.size(F.split(F.regexp_extract(text, DECIMAL_HEADING, 1), r"\.")).cast("int")
    return (
        F.when((F.lower(text) == "abstract") | is_structural_heading(text), F.lit(1))
        .when(F.rlike(text, F.lit(DECIMAL_HEADING)), F.greatest(decimal, F.coalesce(nesting, decimal)))
        .when(F.rlike(text, F.lit(LETTER_HEADING)), F.greatest(F.lit(2), F.coalesce(nesting, F.lit(2))))
        .otherwise(F.greatest(F.lit(1), F.coalesce(nesting, F.lit(1))))
    )


def _count_of(text: Column, signs: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, signs, ""))


def _letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))


def looks_like_equation(text: Column) -> Column:
    return equation_shape(normalize_whitespace(text))


def equation_shape(clean: Column) -> Column:
    """looks_like_equation of a text whose white space is normalized."""
    low = F.lower(clean)
    signs = _count_of(clean, OPERATORS)
    lead = F.startswith(low, F.lit("where ")) | F.startswith(low, F.lit("thus ")) | F.startswith(low, F.lit("therefore "))
    tagged = F.rlike(clean, F.lit(EQUATION_LABEL))
    return (clean != "") & (F.char_length(clean) <= 220) & ~lead & (signs >= 1) & (_letters(clean) >= 2) & (tagged | (signs >= 2) | (F.char_length(clean) <= 80))


def looks_like_explanation(text: Column) -> Column:
    return one_of(F.lower(text), EXPLANATION)


def looks_like_algorithm_step(text: Column) -> Column:
    low = F.lower(text)
    return F.rlike(low, F.lit(ALGORITHM_STEP)) | F.startswith(low, F.lit("if ")) | F.startswith(low, F.lit("for ")) | F.startswith(low, F.lit("while ")) | F.startswith(low, F.lit("return "))


def looks_like_closing_tail(text: Column) -> Column:
    clean = normalize_whitespace(text)
    return (clean != "") & (F.rlike(clean, F.lit(r"(?i)^[)\]}\s]+(?:\d+|[a-z]\b|[+\-*/^=].*)?$")) | F.rlike(clean, F.lit(r"^\^\s*\d+$")))


def looks_like_equation_fragment(text: Column) -> Column:
    clean = normalize_whitespace(text)
    n, signs = F.char_length(clean), _count_of(clean, "=+-*/^()[]{}<>")
    wide = (signs >= 2) & (_letters(clean) <= F.greatest(F.lit(6), F.floor(n / 3)))
    return (clean != "") & (n <= 120) & ~looks_like_explanation(clean) & (((n <= 12) & (signs >= 1)) | looks_like_closing_tail(clean) | wide)


def equation_incomplete(text: Column) -> Column:
    clean = normalize_whitespace(text)
    open_ends = F.rlike(clean, F.lit(r"[=+\-*/(\[{]$")) | F.rlike(clean, F.lit(r"[\p{L}\p{N}_]\s*\^\s*$"))
    unbalanced = (_count_of(clean, "(") > _count_of(clean, ")")) | (_count_of(clean, "[") > _count_of(clean, "]"))
    return (clean != "") & (open_ends | unbalanced)


def merge_equation(left: Column, right: Column) -> Column:
    both = F.concat(normalize_whitespace(left), F.lit(" "), normalize_whitespace(right))
    return normalize_whitespace(F.regexp_replace(F.regexp_replace(both, r"\s+([)\]}])", "$1"), r"([(\[{])\s+", "$1"))


def looks_like_front_matter(text: Column) -> Column:
    low = F.lower(text)
    lead = F.startswith(low, F.lit("index terms")) | F.startswith(low, F.lit("keywords"))
    marked = one_of(low, ("roll no", "department of", "university", "bsai", "bsds", "@"))
    capital = F.forall(words(text), lambda w: ~F.rlike(w, F.lit(r"^\p{L}")) | F.rlike(w, F.lit(r"^\p{Lu}")))
    return lead | marked | ((F.size(words(text)) <= 6) & capital)


def title_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: F.char_length(w) > 2), F.lower)))


def format_row(headers: Column, row: Column) -> Column:
    """Cells as `header: value`, joined by bars. With one cell fewer than headers, the first cell comes before the shifted pairs and in them again."""
    pair = lambda h, v: F.when(normalize_whitespace(v) != "", F.concat(h, F.lit(": "), v))
    join = lambda parts: F.array_join(F.filter(parts, lambda p: p.isNotNull()), " | ")
    clean = F.filter(F.transform(row, normalize_whitespace), lambda c: c != "")
    shifted = F.concat(F.array(F.when(F.get(row, F.lit(0)) != "", F.concat(F.get(headers, F.lit(0)), F.lit(": "), F.get(row, F.lit(0))))), F.zip_with(F.slice(headers, F.lit(2), F.size(row)), row, pair))
    return (
        F.when(F.size(clean) == 0, F.lit(""))
        .when(F.size(headers) == F.size(row), join(F.zip_with(headers, row, pair)))
        .when((F.size(headers) > 1) & (F.size(row) == F.size(headers) - 1), join(shifted))
        .otherwise(F.array_join(clean, " | "))
    )


def positional_values(text: Column) -> Column:
    """What follows the colon of each part between bars. F.btrim itself as the function would be given an element's place as the signs to trim."""
    parts = F.filter(F.transform(F.split(text, r"\|"), lambda p: F.btrim(p)), lambda p: F.contains(p, F.lit(":")))
    return F.transform(parts, lambda p: normalize_whitespace(F.regexp_replace(p, "^[^:]*:", "")))


def explicit_equation(text: Column) -> Column:
    r"""What stands between $$ and $$, or \[ and \]."""
    return F.coalesce(found(text, r"(?s)^\s*\$\$(.+?)\$\$\s*$"), found(text, r"(?s)^\s*\\\[(.+?)\\\]\s*$"))


def milliseconds(seconds: Column) -> Column:
    return F.expr("1").cast("long") * (seconds * 1000).cast("long")


def confidence(logprob: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + logprob / 10)), 4)


def rewrite_query(text: Column) -> Column:
    clean = F.transform(words(text), lambda w: F.lower(strip_signs(w)))
    return F.array_join(F.filter(clean, lambda w: (w != "") & ~w.isin(*REWRITE_STOP_WORDS)), " ")

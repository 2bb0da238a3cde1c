"""Payloads: canonical hashes, plans and verifications read from model answers, heterogeneous tables, hashed embeddings."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(entries: Column) -> Column:
    """A flat map of texts as JSON with sorted keys."""
    pairs = F.array_sort(F.transform(F.map_entries(entries), lambda e: F.struct(e["key"], e["value"])))
    return F.to_json(F.map_from_entries(pairs))


def request_hash(entries: Column) -> Column:
    return F.sha2(canonical_json(entries), 256)


@F.pandas_udf(T.StringType())
def nested_request_hash(payloads: pd.Series) -> pd.Series:
    """SHA-256 of nested JSON texts in canonical form (sorted keys, ASCII, no blanks); null for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return payloads.map(one)


def read_plan(answer: Column) -> Column:
    """points and sources of a plan in a model's answer, whole or between the outer braces; empty lists where they are missing."""
    schema = "points array<string>, sources array<int>"
    parsed = F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema), F.from_json(F.lit("{}"), schema))
    return F.struct(F.coalesce(parsed["points"], F.array().cast("array<string>")).alias("points"), F.filter(F.coalesce(parsed["sources"], F.array().cast("array<int>")), lambda s: s.isNotNull()).alias("sources"))


def read_verification(answer: Column) -> Column:
    schema = "supported boolean, issues array<string>"
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)
    return F.struct(F.coalesce(parsed["supported"], F.lit(False)).alias("supported"), F.coalesce(parsed["issues"], F.array().cast("array<string>")).alias("issues"))


def table_of(data: str | None) -> tuple[list[str], list[list[str]]]:
    """Headers and rows of JSON table data: an object with headers and rows, a list of objects, lists of cells, or scalars.

    Headers that are all numbers say nothing and are left out.
    """
    cell = lambda v: " ".join(str(v.get("text", "") if isinstance(v, dict) else "" if v is None else v).split())
    try:
        value = json.loads(data or "null")
    except ValueError:
        return [], []
    if isinstance(value, dict):
        headers, rows = value.get("headers") or [], value.get("rows") or []
    elif isinstance(value, list) and value and all(isinstance(r, dict) and "text" not in r for r in value):
        headers = list(dict.fromkeys(k for r in value for k in r))
        rows = [[r.get(h) for h in headers] for r in value]
    else:
        rows = value if isinstance(value, list) else []
        headers, rows = (rows[0], rows[1:]) if len(rows) > 1 and isinstance(rows[0], list) else ([], rows)
    headers = [h for h in map(cell, headers) if h]
    if headers and all(re.fullmatch(r"\d+", h) for h in headers):
        headers = []
    return headers, [[cell(c) for c in (r if isinstance(r, list) else [r])] for r in rows]


@F.pandas_udf(T.StructType([T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("n_rows", T.IntegerType()), T.StructField("first_row", T.ArrayType(T.StringType()))]))
def table_data(data: pd.Series) -> pd.DataFrame:
    got = data.map(table_of)
    return pd.DataFrame({"headers": got.map(lambda t: t[0]), "n_rows": got.map(lambda t: len(t[1])), "first_row": got.map(lambda t: t[1][0] if t[1] else [])})


def hash_embedder(size: int = 64):
    """An offline embedder: words hashed to signed dimensions, unit length. Stands where a provider's model would."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            out = [0.0] * size
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[h % size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in out)) or 1.0
            return [x / norm for x in out]

        return texts.map(one)

    return embed

"""Scalar functions over the corpus: one query each, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvex.functions import text as T
from corvex.plans.base import DOCS_SQL, LINES_SQL, documents, lines, query, table

_WS = T.WS
_NORM = f"trim(regexp_replace(x, '{_WS}+', ' ', 'g'))"
_WORDS = f"list_filter(string_split_regex(x, '{_WS}+'), lambda w: w <> '')"
_TERMS_ALL = f"list_filter(list_transform({_WORDS}, lambda w: lower(trim(w, '.,!?;:-_()[]{{}}''\"'))), lambda w: length(w) > 2)"

#: A sentence with a label, number or lead word in front, so that every detector meets lines that it accepts.
_LEADS = ("Table IV: ", "Figure 3a. ", "Algorithm 2 ", "1.2 ", "A. ", "where ", "Step 3 ", "IV. ", "2. ", "Abstract - ", "keywords ", "x = y + ")


def _marked(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("order_index") % len(_LEADS) + 1).cast("int"))
    tail = F.when(F.col("document_id") % 3 == 0, " (12)").otherwise("")
    each = lines(spark, sf).select("document_id", (F.col("order_index") * 100000).alias("base"), F.posexplode(F.split("content", r"\. ")).alias("at", "sentence"))
    return each.select("document_id", (F.col("base") + F.col("at")).alias("order_index"), "sentence").select("document_id", "order_index", F.concat(lead, "sentence", tail).alias("x"))


_MARKED_SQL = LINES_SQL + f""", sentences AS (SELECT document_id, order_index * 100000 + generate_subscripts(string_split(content, '. '), 1) - 1 AS order_index, unnest(string_split(content, '. ')) AS sentence FROM lines),
  marked AS (SELECT document_id, order_index::INT AS order_index, (['{"','".join(_LEADS)}'])[order_index % {len(_LEADS)} + 1] || sentence
  || CASE WHEN document_id % 3 = 0 THEN ' (12)' ELSE '' END AS x FROM sentences)"""


def _scalar(name: str, columns: dict, sql: dict[str, str], marked: bool = False):
    """A query of columns of x for each line: Spark expressions and their SQL."""
    base = (lambda s, d: _marked(s, d)) if marked else (lambda s, d: lines(s, d).select("document_id", "order_index", F.col("content").alias("x")))
    cte = _MARKED_SQL if marked else LINES_SQL + ", marked AS (SELECT document_id, order_index, content AS x FROM lines)"
    body = ", ".join(f"{v} AS {k}" for k, v in sql.items())

    @query(name, f"WITH {cte} SELECT document_id, order_index, {body} FROM marked")
    def run(spark, sf):
        return base(spark, sf).select("document_id", "order_index", *(c(F.col("x")).alias(k) for k, c in columns.items()))


def _got(pattern: str, group: int = 1) -> str:
    return f"CASE WHEN regexp_matches(x, '{pattern}') THEN regexp_extract(x, '{pattern}', {group}) END"


_scalar("i01_normalize_whitespace", {"clean": T.normalize_whitespace}, {"clean": _NORM})
_scalar("i02_token_count", {"n_tokens": lambda x: T.token_count(x).cast("long")}, {"n_tokens": f"greatest(1, len({_WORDS}))::BIGINT"})
_scalar("i03_token_estimate", {"n_tokens": T.token_estimate}, {"n_tokens": "greatest(1, length(x) // 4)::BIGINT"})
_scalar("i04_content_hash", {"sha": lambda x: F.sha2(x, 256), "md5": F.md5}, {"sha": "sha256(x)", "md5": "md5(x)"})
_REDACT = f"regexp_replace(regexp_replace(x, '{T.EMAIL}', '[redacted-email]', 'g'), '{T.PHONE}', '[redacted-phone]', 'g')"
_scalar("i06_redact_text", {"clean": T.redact_text}, {"clean": f"CASE WHEN length({_REDACT}) > 200 THEN left({_REDACT}, 200) || '...' ELSE {_REDACT} END"})
_scalar("i08_conversation_title", {"title": lambda x: F.left(T.normalize_whitespace(x), F.lit(80))}, {"title": f"left({_NORM}, 80)"})
_scalar("i09_preview", {"short": lambda x: T.preview(x, 60)}, {"short": f"CASE WHEN length({_NORM}) <= 60 THEN {_NORM} ELSE left({_NORM}, 57) || '...' END"})
_scalar(
    "i11_labels", {"table_label": lambda x: T.found(x, T.TABLE_LABEL), "figure_label": lambda x: T.found(x, T.FIGURE_LABEL), "algorithm_label": lambda x: T.found(x, T.ALGORITHM_LABEL), "equation_label": lambda x: T.found(x, T.EQUATION_LABEL)},
    {"table_label": _got(T.TABLE_LABEL), "figure_label": _got(T.FIGURE_LABEL), "algorithm_label": _got(T.ALGORITHM_LABEL), "equation_label": _got(T.EQUATION_LABEL)}, marked=True)
_HEAD = " OR ".join(f"regexp_matches(x, '{p}')" for p in (T.NUMBERED_HEADING, T.DECIMAL_HEADING, T.ROMAN_HEADING, T.LETTER_HEADING))
_LABELS = " OR ".join(f"regexp_matches(x, '{p}')" for p in (T.TABLE_LABEL, T.FIGURE_LABEL, T.ALGORITHM_LABEL))
_STRUCT = f"(regexp_matches(trim(x), '{T.NUMBERED_HEADING}') OR regexp_matches(trim(x), '{T.ROMAN_HEADING}'))"
_scalar(
    "i12_headings", {"heading": T.looks_like_heading, "structural": T.is_structural_heading, "level": lambda x: T.heading_level(x, F.lit(None).cast("int"))},
    {"heading": f"length(x) BETWEEN 1 AND 140 AND NOT ({_LABELS}) AND ({_HEAD})", "structural": _STRUCT,
     "level": f"CASE WHEN lower(x) = 'abstract' OR {_STRUCT} THEN 1 WHEN regexp_matches(x, '{T.DECIMAL_HEADING}') THEN len(string_split(regexp_extract(x, '{T.DECIMAL_HEADING}', 1), '.')) WHEN regexp_matches(x, '{T.LETTER_HEADING}') THEN 2 ELSE 1 END::INT"}, marked=True)


def _signs(x: str, signs: str) -> str:
    return f"(length({x}) - length(translate({x}, '{signs}', '')))"


_LETTERS = rf"length(regexp_replace({_NORM}, '[^\p{{L}}]', '', 'g'))"
_OPS = _signs(_NORM, T.OPERATORS)
_EXPL = "(" + " OR ".join(f"contains(lower(x), '{p}')" for p in T.EXPLANATION) + ")"
_scalar(
    "i13_detectors", {"equation": T.looks_like_equation, "explanation": T.looks_like_explanation, "step": T.looks_like_algorithm_step},
    {"equation": f"{_NORM} <> '' AND length({_NORM}) <= 220 AND NOT (lower({_NORM}) LIKE 'where %' OR lower({_NORM}) LIKE 'thus %' OR lower({_NORM}) LIKE 'therefore %') AND {_OPS} >= 1 AND {_LETTERS} >= 2 AND (regexp_matches({_NORM}, '{T.EQUATION_LABEL}') OR {_OPS} >= 2 OR length({_NORM}) <= 80)",
     "explanation": _EXPL, "step": f"regexp_matches(lower(x), '{T.ALGORITHM_STEP}') OR lower(x) LIKE 'if %' OR lower(x) LIKE 'for %' OR lower(x) LIKE 'while %' OR lower(x) LIKE 'return %'"}, marked=True)
_TAIL = rf"({_NORM} <> '' AND (regexp_matches({_NORM}, '(?i)^[)\]}}\s]+(?:\d+|[a-z]\b|[+\-*/^=].*)?$') OR regexp_matches({_NORM}, '^\^\s*\d+$')))"
_FS = _signs(_NORM, "=+-*/^()[]{}<>")
_scalar(
    "i14_equation_fragments", {"incomplete": T.equation_incomplete, "tail": T.looks_like_closing_tail, "fragment": T.looks_like_equation_fragment, "merged": lambda x: T.merge_equation(x, F.lit(" ( a ) "))},
    {"incomplete": rf"{_NORM} <> '' AND (regexp_matches({_NORM}, '[=+\-*/(\[{{]$') OR regexp_matches({_NORM}, '\w+\s*\^\s*$') OR {_signs(_NORM, '(')} > {_signs(_NORM, ')')} OR {_signs(_NORM, '[')} > {_signs(_NORM, ']')})",
     "tail": _TAIL, "fragment": f"{_NORM} <> '' AND length({_NORM}) <= 120 AND NOT {_EXPL} AND ((length({_NORM}) <= 12 AND {_FS} >= 1) OR {_TAIL} OR ({_FS} >= 2 AND {_LETTERS} <= greatest(6, length({_NORM}) // 3)))",
     "merged": rf"trim(regexp_replace(regexp_replace(regexp_replace({_NORM} || ' ( a )', '\s+([)\]}}])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g'), '{_WS}+', ' ', 'g'))"}, marked=True)
_scalar(
    "i15_front_matter", {"front": T.looks_like_front_matter, "index_terms": lambda x: F.startswith(F.lower(x), F.lit("index terms")) | F.startswith(F.lower(x), F.lit("keywords"))},
    {"front": rf"lower(x) LIKE 'index terms%' OR lower(x) LIKE 'keywords%' OR contains(lower(x), 'roll no') OR contains(lower(x), 'department of') OR contains(lower(x), 'university') OR contains(lower(x), 'bsai') OR contains(lower(x), 'bsds') OR contains(lower(x), '@') OR (len({_WORDS}) <= 6 AND len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^\p{{L}}') AND NOT regexp_matches(w, '^\p{{Lu}}'))) = 0)",
     "index_terms": "lower(x) LIKE 'index terms%' OR lower(x) LIKE 'keywords%'"}, marked=True)


def _row(x, n: int):
    """The first three words of a line as headers of the next n. The words are bound once: spelled out, every use would split the line anew."""
    bound = F.transform(F.array(F.slice(T.words(x), 1, 6)), lambda w: T.format_row(F.slice(w, 1, 3), F.slice(w, 4, n)))
    return F.get(bound, F.lit(0))


_scalar(
    "i16_table_row", {"full": lambda x: _row(x, 3), "short": lambda x: _row(x, 2)},
    {"full": f"(SELECT CASE WHEN len(r) = 0 THEN '' WHEN len(h) = len(r) THEN list_aggregate(list_transform(list_zip(h, r), lambda p: p[1] || ': ' || p[2]), 'string_agg', ' | ') WHEN len(h) > 1 AND len(r) = len(h) - 1 THEN list_aggregate(list_concat([h[1] || ': ' || r[1]], list_transform(list_zip(h[2:], r), lambda p: p[1] || ': ' || p[2])), 'string_agg', ' | ') ELSE list_aggregate(r, 'string_agg', ' | ') END FROM (SELECT ({_WORDS})[1:3] AS h, ({_WORDS})[4:6] AS r))",
     "short": f"(SELECT CASE WHEN len(r) = 0 THEN '' WHEN len(h) = len(r) THEN list_aggregate(list_transform(list_zip(h, r), lambda p: p[1] || ': ' || p[2]), 'string_agg', ' | ') WHEN len(h) > 1 AND len(r) = len(h) - 1 THEN list_aggregate(list_concat([h[1] || ': ' || r[1]], list_transform(list_zip(h[2:], r), lambda p: p[1] || ': ' || p[2])), 'string_agg', ' | ') ELSE list_aggregate(r, 'string_agg', ' | ') END FROM (SELECT ({_WORDS})[1:3] AS h, ({_WORDS})[4:5] AS r))"})
_scalar(
    "i17_positional_rows", {"positional": lambda x: F.rlike(F.concat(F.lit("0: "), x), F.lit(r"(?:^|\|\s*)\d+:\s*")), "row_values": lambda x: F.array_join(T.positional_values(F.concat(F.lit("0: "), F.regexp_replace(x, " ", " | 1: "))), ";")},
    {"positional": r"regexp_matches('0: ' || x, '(?:^|\|\s*)\d+:\s*')", "row_values": f"coalesce(list_aggregate(list_transform(list_filter(list_transform(string_split('0: ' || replace(x, ' ', ' | 1: '), '|'), lambda p: trim(p)), lambda p: contains(p, ':')), lambda p: trim(regexp_replace(regexp_replace(p, '^[^:]*:', ''), '{_WS}+', ' ', 'g'))), 'string_agg', ';'), '')"})
_scalar("i18_explicit_equation", {"equation": lambda x: T.explicit_equation(F.concat(F.lit("$$"), x, F.lit("$$")))}, {"equation": r"CASE WHEN regexp_matches('$$' || x || '$$', '(?s)^\s*\$\$(.+?)\$\$\s*$') THEN regexp_extract('$$' || x || '$$', '(?s)^\s*\$\$(.+?)\$\$\s*$', 1) END"})
_scalar("i19_title_tokens", {"tokens": lambda x: F.array_join(T.title_tokens(x), " ")}, {"tokens": "coalesce(list_aggregate(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(x, '([A-Za-z0-9]+)', 1), lambda w: length(w) > 2), lambda w: lower(w)))), 'string_agg', ' '), '')"})
_scalar("i33_abstract_lead", {"lead": lambda x: T.normalize_whitespace(F.when(F.rlike(x, F.lit(T.ABSTRACT_LEAD)), F.regexp_extract(x, T.ABSTRACT_LEAD, 1)))}, {"lead": f"CASE WHEN regexp_matches(x, '{T.ABSTRACT_LEAD}') THEN trim(regexp_replace(regexp_extract(x, '{T.ABSTRACT_LEAD}', 1), '{_WS}+', ' ', 'g')) ELSE '' END"}, marked=True)
_scalar("d13_rewrite_query", {"rewritten": T.rewrite_query}, {"rewritten": f"coalesce(list_aggregate(list_filter(list_transform({_WORDS}, lambda w: lower(trim(w, '.,!?;:-_()[]{{}}''\"'))), lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in T.REWRITE_STOP_WORDS)})), 'string_agg', ' '), '')"})
_scalar("d21_terms", {"terms": lambda x: F.array_join(F.array_sort(T.terms(x)), " ")}, {"terms": f"coalesce(list_aggregate(list_sort(list_distinct({_TERMS_ALL})), 'string_agg', ' '), '')"})
_scalar("i34_chunk_kinds", {"chunk_type": lambda x: F.when(F.rlike(x, F.lit("^(Table|Figure)")), "table").when(F.rlike(x, F.lit("^x =")), "equation").otherwise("paragraph"), "node_type": lambda x: F.when(F.rlike(x, F.lit("^Table")), "table").when(F.rlike(x, F.lit("^x =")), "equation_group").when(F.rlike(x, F.lit("^Algorithm")), "algorithm").when(F.rlike(x, F.lit("^Figure")), "figure_caption").otherwise("prose_group")},
        {"chunk_type": "CASE WHEN regexp_matches(x, '^(Table|Figure)') THEN 'table' WHEN regexp_matches(x, '^x =') THEN 'equation' ELSE 'paragraph' END", "node_type": "CASE WHEN regexp_matches(x, '^Table') THEN 'table' WHEN regexp_matches(x, '^x =') THEN 'equation_group' WHEN regexp_matches(x, '^Algorithm') THEN 'algorithm' WHEN regexp_matches(x, '^Figure') THEN 'figure_caption' ELSE 'prose_group' END"}, marked=True)


@query("i07_redact_payload", f"""WITH {DOCS_SQL}, pairs AS (
  SELECT document_id, unnest(['title', 'Api_Key', 'monkey', 'note']) AS k, unnest([title, lang, status, text]) AS x FROM docs)
SELECT document_id, k, CASE WHEN contains(lower(k), 'token') OR contains(lower(k), 'secret') OR contains(lower(k), 'password') OR contains(lower(k), 'authorization') OR contains(lower(k), 'key') THEN '[redacted-secret]'
  WHEN length({_REDACT}) > 200 THEN left({_REDACT}, 200) || '...' ELSE {_REDACT} END AS v FROM pairs""")
def redact_payload(spark, sf):
    payload = F.create_map(F.lit("title"), "title", F.lit("Api_Key"), "lang", F.lit("monkey"), "status", F.lit("note"), "text")
    return documents(spark, sf).select("document_id", F.explode(T.redact_payload(payload)).alias("k", "v"))


@query("i20_audio_numbers", "SELECT event_id, trunc(value * 1000)::BIGINT AS ms, round(greatest(0.0, least(1.0, 1 + (-value) / 10)), 4) AS confidence FROM events")
def audio_numbers(spark, sf):
    return table(spark, sf, "events").select("event_id", T.milliseconds(F.col("value")).alias("ms"), T.confidence(-F.col("value")).alias("confidence"))


@query("i21_mean_pooling", "SELECT label, pos::INT AS pos, round(avg(v), 6) AS v FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL")
def mean_pooling(spark, sf):
    return table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))


@query("i22_vector_literal", "SELECT vec_id, '[' || list_aggregate(list_transform(embedding, lambda v: printf('%.8f', v::DOUBLE)), 'string_agg', ',') || ']' AS literal FROM embeddings")
def vector_literal(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", T.vector_literal("embedding").alias("literal"))


@query("i28_upload_url", "SELECT page_id, regexp_replace(u, '^([a-z]+://[^/]+)(/object/upload/sign/)', '\\1/storage/v1\\2') AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^([a-z]+://[^/]+)/', '\\1/object/upload/sign/') ELSE url END AS u FROM pages)")
def upload_url(spark, sf):
    given = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^([a-z]+://[^/]+)/", "$1/object/upload/sign/")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(given, "^([a-z]+://[^/]+)(/object/upload/sign/)", "$1/storage/v1$2").alias("url"))


@query("i29_workspace_names", """SELECT c_custkey, d || '''s Workspace' AS name, 'workspace-' || left(replace(c_name, '-', ''), 12) AS slug FROM (
  SELECT c_custkey, c_name, trim(replace(replace(replace(split_part('mr.' || lower(c_name) || '_x@host', '@', 1), '.', ' '), '_', ' '), '-', ' ')) AS l,
    list_aggregate(list_transform(string_split(trim(replace(replace(replace(split_part('mr.' || lower(c_name) || '_x@host', '@', 1), '.', ' '), '_', ' '), '-', ' ')), ' '), lambda w: upper(left(w, 1)) || w[2:]), 'string_agg', ' ') AS d FROM customer)""")
def workspace_names(spark, sf):
    local = F.split_part(F.concat(F.lit("mr."), F.lower("c_name"), F.lit("_x@host")), F.lit("@"), F.lit(1))
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.initcap(F.btrim(F.translate(local, "._-", "   "))), F.lit("'s Workspace")).alias("name"), F.concat(F.lit("workspace-"), F.left(F.replace("c_name", F.lit("-")), F.lit(12))).alias("slug"))


@query("i30_default_title", r"SELECT page_id, regexp_extract(url, '([^/?#]+?)(?:\.[^./?#]*)?(?:[?#].*)?$', 1) AS title FROM pages")
def default_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]+?)(?:\.[^./?#]*)?(?:[?#].*)?$", 1).alias("title"))


@query("i26_provider_chain", "SELECT user_id, pos::INT AS pos, split_part(t, ':', 1) AS provider, split_part(t, ':', 2) AS model FROM (SELECT user_id, unnest(string_split(c, '|')) AS t, generate_subscripts(string_split(c, '|'), 1) - 1 AS pos FROM (SELECT DISTINCT user_id, event_type || ':m' || user_id || '|local:small' AS c FROM events))")
def provider_chain(spark, sf):
    chain = F.concat("event_type", F.lit(":m"), "user_id", F.lit("|local:small"))
    targets = table(spark, sf, "events").select("user_id", chain.alias("c")).distinct().select("user_id", F.posexplode(F.split("c", r"\|")).alias("pos", "t"))
    return targets.select("user_id", "pos", F.split_part("t", F.lit(":"), F.lit(1)).alias("provider"), F.split_part("t", F.lit(":"), F.lit(2)).alias("model"))


@query("i24_json_repair", r"""SELECT event_id, coalesce(CASE WHEN json_valid(x) THEN json_extract_string(x, '$.k') END, CASE WHEN json_valid(regexp_extract(x, '(?s)\{.*\}')) THEN json_extract_string(regexp_extract(x, '(?s)\{.*\}'), '$.k') END) AS k
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'Answer: ' || props || ' done' ELSE 'none' END AS x FROM events)""")
def json_repair(spark, sf):
    x = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).otherwise("none")
    parsed = lambda c: F.try_variant_get(F.try_parse_json(c), "$.k", "string")
    return table(spark, sf, "events").select("event_id", F.coalesce(parsed(x), parsed(F.regexp_extract(x, r"(?s)\{.*\}", 0))).alias("k"))


@query("i27_json_merge", "SELECT user_id, k, v FROM (SELECT user_id, unnest(['stage', 'count', 'user']) AS k, unnest([max(event_type), count(*)::VARCHAR, 'u' || user_id]) AS v FROM events GROUP BY user_id)")
def json_merge(spark, sf):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")  # the right side of a merge wins
    per = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"), F.count("*").cast("string").alias("n"))
    left, right = F.create_map(F.lit("stage"), "a", F.lit("count"), "n"), F.create_map(F.lit("stage"), "b", F.lit("user"), F.concat(F.lit("u"), "user_id"))
    return per.select("user_id", F.explode(F.map_concat(left, right)).alias("k", "v"))


@query("i35_section_context", """WITH pairs AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 END AS l, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 4 END AS r FROM documents)
  SELECT doc_id, l IS NOT DISTINCT FROM r AS same_section, coalesce(l = r, true) AS same_top, coalesce(r - l IN (0, 1), true) AS near_page FROM pairs""")
def section_context(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 3).alias("l"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 4).alias("r"))
    return d.select("doc_id", F.col("l").eqNullSafe(F.col("r")).alias("same_section"), F.coalesce(F.col("l") == F.col("r"), F.lit(True)).alias("same_top"), F.coalesce((F.col("r") - F.col("l")).isin(0, 1), F.lit(True)).alias("near_page"))

"""Passes over a document's layout items that depend on what the pass has built so far: equation fragments and table groups.

One document's items, in order, are one fold; a document is one row of the input already, so a fold is no larger than that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvex.functions.text import EXPLANATION

# Signs of fragments, lengths, how far an orphan looks back, what it does not look past, statuses and warnings.
SIGNS = "=+-*/^()[]{}<>"
TAIL = re.compile(r"[)\]}\s]+(?:\d+|[a-z]\b|[+\-*/^=].*)?$", re.IGNORECASE)
POWER = re.compile(r"\^\s*\d+$")
OPEN_END = re.compile(r"[=+\-*/(\[{]$|\w\s*\^\s*$")
MOST_FRAGMENT, MOST_ORPHAN, LOOK_BACK = 120, 12, 6
BORDERS = ("heading", "table_caption", "table_row", "figure_caption", "algorithm")
ROW_BACKED, CAPTION_ONLY, UNASSIGNED = "row_backed", "caption_only", "unassigned_row"
NO_ROWS = "Table caption '{}' had no recoverable table rows."
NO_CAPTION = "Unassigned table row on page {} could not be matched to a caption."


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


def is_tail(text: str) -> bool:
    """Whether the text closes an equation: brackets and what may follow them, or a power."""
    return bool(text and (TAIL.match(text) or POWER.match(text)))


def is_fragment(text: str) -> bool:
    signs, letters = sum(c in SIGNS for c in text), sum(c.isalpha() for c in text)
    if not text or len(text) > MOST_FRAGMENT or any(x in text.lower() for x in EXPLANATION):
        return False
    return (len(text) <= MOST_ORPHAN and signs > 0) or is_tail(text) or (signs >= 2 and letters <= max(6, len(text) // 3))


def is_incomplete(text: str) -> bool:
    return bool(text) and (bool(OPEN_END.search(text)) or any(text.count(a) > text.count(b) for a, b in ("()", "[]")))


def joined(left: str, right: str) -> str:
    both = re.sub(r"\s+([)\]}])", r"\1", f"{left} {right}")
    return clean(re.sub(r"([(\[{])\s+", r"\1", both))


def follows_page(first: int | None, then: int | None) -> bool:
    return first is None or then is None or 0 <= then - first <= 1


def _with_context(rows: list[dict]) -> list[dict]:
    """Each row with the texts of the headings open at it (its own included)."""
    open_: list[tuple[int, str]] = []
    context: tuple[str, ...] = ()
    for r in rows:
        if r["kind"] == "heading":
            level = r.get("level") or 1
            open_ = [*((n, t) for n, t in open_ if n < level), (level, r["text"])]
            context = tuple(t for _, t in open_)
        r["context"] = context
    return rows


def fold_equations(rows: list[dict]) -> list[dict]:
    """Items (kind, text, page_no, level) with equation fragments joined: columns merged (fragments taken in) and orphan.

    An equation that is incomplete, judged on all that it has taken in, takes the fragments that follow it in its section on
    its page or the next. One that then is a short fragment itself closes the nearest equation among the six items before,
    if that is incomplete and nothing but fragments stands between; else it stays, as an orphan.
    """
    out: list[dict] = []

    def settle() -> None:
        last = out[-1]
        if not (len(last["text"]) <= MOST_ORPHAN and is_fragment(last["text"])):
            return
        host = None
        if is_tail(last["text"]):
            for r in out[-2 : -2 - LOOK_BACK : -1]:
                if r["kind"] == "paragraph" and is_fragment(clean(r["text"])):
                    continue
                host = r if r["kind"] == "equation" else None
                break
        near = host and (not host["context"] or not last["context"] or host["context"][0] == last["context"][0]) and follows_page(host["page_no"], last["page_no"])
        if near and is_incomplete(host["text"]):
            host["text"], host["merged"] = joined(host["text"], last["text"]), host["merged"] + 1 + last["merged"]
            out.pop()
        else:
            last["orphan"] = True

    open_ = False
    for r in _with_context(rows):
        row = {**r, "merged": 0, "orphan": False}
        if row["kind"] == "equation":
            row["text"] = clean(row["text"])
        if open_:
            head, text = out[-1], clean(row["text"])
            fits = row["kind"] in ("equation", "paragraph") and row["context"] == head["context"] and follows_page(head["page_no"], row["page_no"])
            if fits and is_incomplete(head["text"]) and is_fragment(text):
                head["text"], head["merged"] = joined(head["text"], text), head["merged"] + 1
                continue
            settle()
        out.append(row)
        open_ = row["kind"] == "equation"
    if open_:
        settle()
    return out


def fold_tables(rows: list[dict]) -> list[dict]:
    """Items (item_index, kind, page_no, level, table_id, caption_label) with every table row under one caption: table_id,
    caption_label, status and warning.

    A row keeps the table it names. Else its label chooses among the captions of that label, if there are any, else the
    captions of its page, else all: before comes before after, the same headings before the same last heading before others,
    then the nearest. A caption without an id is named by its document and place.
    """
    rows = _with_context(rows)
    label = lambda r: clean(r["caption_label"]).lower() or None
    captions = [{**r, "at": n, "id": r["table_id"] or f"{r['doc_id']}:{r['item_index']}", "label": label(r)} for n, r in enumerate(rows) if r["kind"] == "table_caption"]
    by_id = {c["id"]: c for c in captions}

    def keys(group: tuple, context: tuple) -> list[tuple]:
        return [(group, 0, context), (group, 1, context[-1] if context else None), (group, 2, None)]

    def remember(seen: dict, c: dict) -> None:
        for group in (("label", c["label"]), ("page", c["page_no"]), ("all", None)):
            for key in keys(group, c["context"]):
                seen[key] = c

    # from the front the last caption under a key is the nearest before, from the back the nearest after
    sides: list[dict[int, dict]] = []
    for order in (range(len(rows)), range(len(rows) - 1, -1, -1)):
        seen: dict[tuple, dict] = {}
        found: dict[int, dict] = {}
        at_caption = {c["at"]: c for c in captions}
        for n in order:
            if n in at_caption:
                remember(seen, at_caption[n])
            elif rows[n]["kind"] == "table_row":
                own = label(rows[n])
                groups = [("label", own)] * bool(own and own != "table") + [("page", rows[n]["page_no"]), ("all", None)]
                found[n] = {g: next((seen[k] for k in keys(g, rows[n]["context"]) if k in seen and (k[1] != 1 or k[2] is not None)), None) for g in groups}
        sides.append(found)

    out, held = [], dict.fromkeys(by_id, 0)
    for n, r in enumerate(rows):
        row = {**r, "status": None, "warning": None}
        if r["kind"] == "table_row":
            best = by_id.get(r["table_id"]) if r["table_id"] else None
            if best is None:
                best = next((s[n][g] for g in sides[0][n] for s in sides if s[n][g]), None)
            if best is None:
                row |= {"status": UNASSIGNED, "warning": NO_CAPTION.format(r["page_no"] or "unknown")}
            else:
                held[best["id"]] += 1
                row |= {"table_id": best["id"], "caption_label": best["label"] or r["caption_label"], "status": ROW_BACKED}
        out.append(row)
    for c in captions:
        row = out[c["at"]]
        row |= {"table_id": c["id"], "caption_label": c["label"] or row["caption_label"], "status": ROW_BACKED if held[c["id"]] else CAPTION_ONLY}
        if not held[c["id"]]:
            row["warning"] = NO_ROWS.format(row["caption_label"] or "Table")
    return out


def _folded(items: DataFrame, fold: Callable[[list[dict]], list[dict]], reads: tuple[str, ...], added: list[T.StructField], changed: tuple[str, ...] = (), kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The fold of every document: it sees the columns `reads` as rows, its columns `added` and `changed` are new, all others follow their rows; `kinds` alone are returned.

    Documents lie whole and in order in a partition, so a batch holds many of them and a task holds a batch and one document.
    """
    names = {f.name for f in added}
    schema = T.StructType([*(f for f in items.schema if f.name not in names), *added])
    arrow, reads = to_arrow_schema(schema), [c for c in items.columns if c in reads]

    def folded(table: pa.Table, ends: list[int]) -> list[pa.RecordBatch]:
        every, out, start = table.select(reads).to_pylist(), [], 0
        for end in ends:
            out += fold([{**r, "__at": n} for n, r in enumerate(every[start:end], start)])
            start = end
        out = [r for r in out if kinds is None or r["kind"] in kinds]
        kept = table.take(pa.array([r["__at"] for r in out], pa.int64()))
        return pa.Table.from_arrays([pa.array([r[f.name] for r in out], f.type) if f.name in names or f.name in changed else kept.column(f.name).cast(f.type) for f in arrow], schema=arrow).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            *ends, _ = [0, *pc.run_end_encode(held.column("doc_id").combine_chunks()).run_ends.to_pylist()]
            if ends[1:]:
                yield from folded(held.slice(0, ends[-1]), ends[1:])
                held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield from folded(held, [held.num_rows])

    return items.repartition("doc_id").sortWithinPartitions("doc_id", "item_index").mapInArrow(run, schema)


def merge_equations(items: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """`fold_equations` of every document (doc_id, item_index, kind, text, page_no, and level of headings, 1 without that column); rows of `kinds` alone, if given."""
    return _folded(items, fold_equations, ("kind", "text", "page_no", "level"), [T.StructField("merged", T.IntegerType()), T.StructField("orphan", T.BooleanType())], ("text",), kinds)


def group_tables(items: DataFrame) -> DataFrame:
    """`fold_tables` of every document (doc_id, item_index, kind, text, page_no, level, table_id, caption_label)."""
    return _folded(items, fold_tables, ("doc_id", "item_index", "kind", "text", "page_no", "level", "table_id", "caption_label"), [T.StructField(n, T.StringType()) for n in ("table_id", "caption_label", "status", "warning")])


def table_warnings(grouped: DataFrame) -> DataFrame:
    """doc_id and warnings: each warning once, those of rows in order, then those of captions in order."""
    own = grouped.where("warning IS NOT NULL").select("doc_id", F.struct(F.col("kind") == "table_caption", "item_index", "warning").alias("w"))
    return own.groupBy("doc_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["warning"])).alias("warnings"))

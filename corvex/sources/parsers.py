"""Parsers of one document each (bytes to blocks): HTML, Markdown, DOCX, text. Small helpers of parse_documents.

A block has block_type, content, section_path (open headings), metadata, and level for headings.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

IGNORED = {"script", "style", "noscript", "svg", "canvas", "template", "head"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
FLOW = {"p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "table", "blockquote", "figure", "body", "form", "dl", "dd", "dt", "pre"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
EQUATION = re.compile(r"^\s*(?:\$\$(.+?)\$\$|\\\[(.+?)\\\])\s*$", re.S)
ALGORITHM = re.compile(r"^\s*(algorithm\s+\d+[a-z]?)\b", re.I)
FIGURE = re.compile(r"^\s*((?:fig(?:ure)?\.?)\s*\d+[a-z]?)\b", re.I)
TABLE = re.compile(r"^\s*(table\s+[ivxlcdm\d]+)\b", re.I)
STEP = re.compile(r"^\s*(?:step\s*\d+|input:|output:|require:|ensure:|\d+\))", re.I)
EXPLAINS = ("where ", "denotes", "represents", "measures", "computes")


def tidy(text: str) -> str:
    return " ".join(text.split())


def row_text(headers: list[str], row: list[str]) -> str:
    """As functions.text.format_row: cells under their headers; of one cell fewer the first comes before the shifted pairs and in them again."""
    if len(headers) == len(row):
        return " | ".join(f"{h}: {c}" for h, c in zip(headers, row))
    if len(headers) > 1 and len(row) == len(headers) - 1:
        return " | ".join([f"{headers[0]}: {row[0]}", *(f"{h}: {c}" for h, c in zip(headers[1:], row))])
    return " | ".join(row)


class Blocks:
    """Collects blocks under the open headings."""

    def __init__(self) -> None:
        self.out: list[dict] = []
        self.path: list[str] = []
        self.equations = self.tables = 0
        self.after_equation: str | None = None

    def add(self, kind: str, text: str, level: int | None = None, **metadata: str) -> None:
        text = text if kind == "code" else tidy(text)
        if not text:
            return
        if kind != "paragraph":
            self.after_equation = None
        if kind == "heading":
            self.path = [*self.path[: max(0, (level or 1) - 1)], text]
        self.out.append({"block_type": kind, "content": text, "level": level, "section_path": list(self.path), "metadata": {k: str(v) for k, v in metadata.items()}})

    def prose(self, text: str, raw: str | None = None) -> None:
        """A paragraph, or the special block that its text shows; the first test that holds decides."""
        text = tidy(text)
        if not text:
            return
        if self.after_equation and any(e in text.lower() for e in EXPLAINS):
            self.add("equation_explanation", text, content_kind="equation_explanation", equation_group_id=self.after_equation)
        elif m := EQUATION.match(raw or text):
            self.equations += 1
            group = f"eq-{self.equations}"
            self.add("equation", m[1] or m[2], content_kind="equation", equation_group_id=group)
            self.after_equation = group
        elif STEP.match(text):
            self.add("algorithm", text, content_kind="algorithm")
        elif m := ALGORITHM.match(text):
            self.add("algorithm", text, content_kind="algorithm", algorithm_label=m[1])
        elif m := FIGURE.match(text):
            self.add("figure_caption", text, content_kind="figure_caption", caption_label=m[1])
        else:
            self.after_equation = None
            self.add("paragraph", text)

    def table(self, rows: list[list[str]], caption: str | None, headed: bool) -> None:
        """Caption and one block for each row; the first row gives the headers where it is marked so, or there are more."""
        rows = [[tidy(c) for c in r if tidy(c)] for r in rows]
        rows = [r for r in rows if r]
        if not rows and not caption:
            return
        self.tables += 1
        group = f"table-{self.tables}"
        label = (m := TABLE.match(caption or "")) and m[1]
        extra = {"table_id": group, **({"caption_label": label} if label else {})}
        headers = rows[0] if rows and (headed or len(rows) > 1) else []
        body = rows[1:] if headers else rows
        if caption:
            self.add("table_caption", caption, content_kind="table_caption", table_status="row_backed" if body else "caption_only", **extra)
        for i, r in enumerate(body):
            self.add("table_row", row_text(headers, r), content_kind="table_row", row_index=i, table_headers=" | ".join(headers), **extra)


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks, self.text = Blocks(), []
        self.stack: list[tuple[str, bool]] = []  # tag, hidden
        self.depth = 0
        self.item: list[int] = []
        self.heading = 0
        self.rows: list[list[str]] | None = None
        self.caption, self.headed, self.cell = "", False, False
        self.outer: list[tuple] = []  # open tables around this one: rows, caption, headed, the text of the cell so far

    @property
    def hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def flush(self) -> None:
        if self.rows is not None:  # a paragraph inside a cell is part of its text
            self.text.append(" ")
            return
        text, self.text = "".join(self.text), []
        if self.hidden or not text.strip():
            return
        if self.heading:
            self.blocks.add("heading", text, self.heading)
        elif self.item:
            self.blocks.add("list_item", text, list_depth=len(self.item), list_index=self.item[-1])
        elif any(t == "pre" for t, _ in self.stack):
            self.blocks.add("paragraph", text, content_kind="code_block")
        else:
            self.blocks.prose(text)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        while self.stack and self.stack[-1][0] in CLOSES.get(tag, ()):
            self.handle_endtag(self.stack[-1][0])
        if tag in FLOW or tag in ("li", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption"):
            self.flush()
        style = (attrs.get("style") or "").replace(" ", "").lower()
        gone = self.hidden or tag in IGNORED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        self.stack.append((tag, gone))
        if gone:
            return
        if tag in ("ul", "ol"):
            self.item.append(-1)
        elif tag == "li" and self.item:
            self.item[-1] += 1
        elif re.fullmatch("h[1-6]", tag):
            self.heading = int(tag[1])
        elif tag == "table":
            if self.rows is not None:
                self.outer.append((self.rows, self.caption, self.headed, self.text))
            self.rows, self.caption, self.headed, self.text = [], "", False, []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th", "caption") and self.rows is not None:
            self.headed |= tag == "th" and len(self.rows) <= 1
            self.text = []
        elif tag == "thead":
            self.headed = True

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            top, gone = self.stack[-1]
            if not gone:
                if self.rows is not None and top in ("td", "th") and self.rows:
                    self.rows[-1].append("".join(self.text))
                    self.text = []
                elif self.rows is not None and top == "caption":
                    self.caption, self.text = "".join(self.text), []
                elif top == "table" and self.rows is not None:
                    self.blocks.table(self.rows, tidy(self.caption) or None, self.headed)
                    self.rows, self.caption, self.headed, self.text = self.outer.pop() if self.outer else (None, "", False, [])
                elif top in FLOW or top in ("li", "figcaption") or re.fullmatch("h[1-6]", top):
                    self.flush()
                if top in ("ul", "ol") and self.item:
                    self.item.pop()
                if re.fullmatch("h[1-6]", top):
                    self.heading = 0
            self.stack.pop()
            if top == tag:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def parse_html(raw: bytes) -> list[dict]:
    parser = _Html()
    parser.feed(raw.decode("utf-8", "replace"))
    parser.close()
    parser.stack = []
    parser.flush()
    return parser.blocks.out


def parse_markdown(raw: bytes) -> list[dict]:
    """Headings, fenced code, tables, lists, display equations, captions, paragraphs."""
    out, lines, held, i = Blocks(), raw.decode("utf-8", "replace").splitlines(), [], 0

    def flush() -> None:
        text = "\n".join(held).strip()
        held.clear()
        if text:
            out.prose(text, text)

    def cells(line: str) -> list[str]:
        return [c.strip() for c in line.strip().strip("|").split("|")]

    while i < len(lines):
        line = lines[i]
        if m := re.match(r"^ {0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*$", line):
            flush()
            out.add("heading", m[2], len(m[1]))
        elif m := re.match(r"^\s*(```+|~~~+)", line):
            flush()
            body = []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(m[1]):
                body.append(lines[i])
                i += 1
            out.add("paragraph", "\n".join(body), content_kind="code_block")
        elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]):
            caption = None
            if held and TABLE.match(held[-1]):
                caption = held.pop()
            flush()
            rows = [cells(line)]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(cells(lines[i]))
                i += 1
            out.table(rows, caption, True)
            continue
        elif m := re.match(r"^(\s*)(?:[-*+]|\d+[.])\s+(.*)$", line):
            flush()
            out.add("list_item", m[2], list_depth=len(m[1]) // 2 + 1)
        elif not line.strip():
            flush()
        else:
            held.append(line)
        i += 1
    flush()
    return out.out


def parse_docx(raw: bytes) -> list[dict]:
    """Word paragraphs and tables by way of HTML."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    text_of = lambda node: html.escape("".join(t.text or "" for t in node.iter(f"{ns}t")))
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{ns}p":
            style = node.find(f"{ns}pPr/{ns}pStyle")
            name = (style.get(f"{ns}val") or "") if style is not None else ""
            tag = f"h{m[1]}" if (m := re.fullmatch(r"Heading([1-6])", name)) else "h1" if name == "Title" else "p"
            out.append(f"<{tag}>{text_of(node)}</{tag}>")
        elif node.tag == f"{ns}tbl":
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{text_of(c)}</td>" for c in r.iter(f"{ns}tc")) + "</tr>" for r in node.iter(f"{ns}tr")) + "</table>")
    return parse_html("".join(out).encode())


def parse_text(raw: bytes) -> list[dict]:
    out = Blocks()
    out.add("paragraph", raw.decode("utf-8", "replace"))
    return out.out


PARSERS = {"html": parse_html, "htm": parse_html, "markdown": parse_markdown, "md": parse_markdown, "docx": parse_docx, "text": parse_text}

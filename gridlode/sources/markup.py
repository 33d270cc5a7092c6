"""Tables in HTML, JATS and CALS markup. Parsing is Python on Arrow batches (markup is not well formed); cells are rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

CELL_DDL = "doc_id long, table_no int, label string, caption string, header_source string, row_idx int, col_idx int, text string, is_header boolean, footnotes array<string>"

# Characters that have a raised or lowered form.
_SUP = dict(zip("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", strict=True))
_SUB = dict(zip("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", strict=True))
_LABEL = re.compile(r"(?i)^\s*((?:supplementary |supplemental |extended data |appendix )?table\s+[A-Z]?[0-9IVXLCDM]+(?:[.\-][0-9]+)*|表\s*[0-9一二三四五六七八九十]+(?:[.\-][0-9]+)*)")


def script(text: str, raised: bool) -> str:
    table = _SUP if raised else _SUB
    return "".join(table[c] for c in text) if text and all(c in table for c in text) else ("^" if raised else "_") + "{" + text + "}" if text.strip() else text


MOST_RIGHT, MOST_CELLS = 1_000, 2_000_000


def place_spans(rows: list[list[tuple[str, int, int, bool]]]) -> list[list[tuple[str, bool]]]:
    """Cells (text, row span, column span, header) to a full grid: a cell takes the next free place and covers its block.

    Spans are bounded as browsers do (MOST_RIGHT columns) and by the rows that are there; a grid of over MOST_CELLS cells is none.
    """
    taken: dict[tuple[int, int], tuple[str, bool]] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, right, head in row:
            while (r, c) in taken:
                c += 1
            down, right = min(max(1, down), len(rows) - r), min(max(1, right), MOST_RIGHT)
            if len(taken) + down * right > MOST_CELLS:
                return []
            for i in range(down):
                for j in range(right):
                    taken.setdefault((r + i, c + j), (text, head))
            c += right
    if not taken:
        return []
    height, width = max(r for r, _ in taken) + 1, max(c for _, c in taken) + 1
    if min(height, len(rows)) * width > MOST_CELLS:
        return []
    return [[taken.get((r, c), ("", False)) for c in range(width)] for r in range(min(height, len(rows)))]


def _number(value: str | None) -> int:
    """A span of ASCII digits; 1 for anything else."""
    value = (value or "").strip()
    return int(value) if value.isascii() and value.isdigit() and len(value) <= 6 and int(value) > 0 else 1


class _Tables(HTMLParser):
    """Collects tables with rows of (text, row span, column span, header); a nested table's text stays in its cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.stack: list[dict] = []
        self.cell: dict | None = None
        self.caption = False
        self.scripts: list[tuple[str, int]] = []
        self.before: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self._close_cell()
            self.stack.append({"rows": [], "caption": "", "thead": False, "inputs": 0, "nested": bool(self.stack), "above": " ".join("".join(self.before[-40:]).split())[-300:]})
        elif self.stack:
            t = self.stack[-1]
            if tag == "thead":
                t["thead"] = True
            elif tag == "input":
                t["inputs"] += 1
            elif tag == "caption":
                self.caption = True
            elif tag == "tr":
                self._close_cell()
                t["rows"].append([])
            elif tag in ("td", "th"):
                self._close_cell()
                if not t["rows"]:
                    t["rows"].append([])
                self.cell = {"parts": [], "down": _number(a.get("rowspan")), "right": _number(a.get("colspan")), "head": tag == "th"}
            elif self.cell is not None and tag in ("sup", "sub"):
                self.scripts.append((tag, len(self.cell["parts"])))
            elif self.cell is not None and tag == "br":
                self.cell["parts"].append("\n")
            elif self.cell is not None and tag in ("p", "div"):
                self.cell["parts"].append(" ")
        elif tag in ("script", "style"):
            self.before.clear()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("sup", "sub") and self.scripts and self.cell is not None:
            kind, at = self.scripts.pop()
            inner = "".join(self.cell["parts"][at:])
            self.cell["parts"][at:] = [script(inner, kind == "sup")]
        elif tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag == "caption":
            self.caption = False
        elif tag == "table" and self.stack:
            self._close_cell()
            done = self.stack.pop()
            if not done["nested"]:
                self.tables.append(done)
                self.before.clear()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["parts"].append(data)
        elif self.caption and self.stack:
            self.stack[-1]["caption"] += data
        elif not self.stack:
            self.before.append(data)

    def _close_cell(self):
        if self.cell is not None and self.stack and self.stack[-1]["rows"]:
            text = "\n".join(" ".join(line.split()) for line in "".join(self.cell["parts"]).split("\n")).strip()
            self.stack[-1]["rows"][-1].append((text, self.cell["down"], self.cell["right"], self.cell["head"]))
        self.cell, self.scripts = None, []

    def close(self):
        super().close()
        while self.stack:
            self.handle_endtag("table")


def html_tables(html: str) -> list[dict]:
    """label, caption, header_source, grid [(text, is_header)], of the tables that are data and not forms or layout."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out, seen = [], set()
    for t in parser.tables:
        rows = [r for r in t["rows"] if r]
        if t["inputs"] >= 2 or not rows:
            continue
        explicit = t["thead"] or all(c[3] for c in rows[0])
        grid = place_spans(rows)
        caption = " ".join(t["caption"].split()) or (t["above"] if _LABEL.match(t["above"]) else "")
        label = _LABEL.match(caption)
        key = (label[1] if label else "", len(grid), tuple(c[0] for c in grid[0]))
        if key in seen:
            continue
        seen.add(key)
        out.append({"label": label[1] if label else "", "caption": caption, "header_source": "explicit" if explicit else "inferred", "grid": grid, "footnotes": []})
    return out


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _xml_text(e: ET.Element) -> str:
    parts = [e.text or ""]
    for child in e:
        inner = _xml_text(child)
        name = _local(child)
        parts.append(script(inner, name == "sup") if name in ("sup", "sub") else "\n" if name in ("br", "break") else f" {inner} " if name in ("p", "div") else inner)
        parts.append(child.tail or "")
    return "\n".join(" ".join(line.split()) for line in "".join(parts).split("\n")).strip()


def _named(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _local(x) == name]


def _more(value: str | None) -> int:
    """Rows that an entry covers, from the number of rows more than one."""
    value = (value or "").strip()
    return int(value) + 1 if value.isascii() and value.isdigit() and len(value) <= 6 else 1


def _cals_rows(group: ET.Element) -> tuple[list[list[tuple[str, int, int, bool]]], int]:
    columns = {c.get("colname"): i for i, c in enumerate(x for x in group if _local(x) == "colspec")}
    rows, heads = [], 0
    for part in group:
        if _local(part) in ("thead", "tbody"):
            for row in (r for r in part if _local(r) == "row"):
                cells = []
                for entry in (x for x in row if _local(x) == "entry"):
                    first, last = columns.get(entry.get("namest")), columns.get(entry.get("nameend"))
                    right = last - first + 1 if first is not None and last is not None else 1
                    cells.append((_xml_text(entry), _more(entry.get("morerows")), right, _local(part) == "thead"))
                rows.append(cells)
                heads += _local(part) == "thead"
    return rows, heads


def xml_tables(xml: str) -> list[dict]:
    """Tables of JATS wrappers (XHTML rows or CALS groups); several CALS groups stand side by side, a repeated first column goes."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    wraps = _named(root, "table-wrap") or [e for e in _named(root, "table") if _named(e, "tgroup")]
    out = []
    for wrap in wraps:
        label = next((_xml_text(x) for x in _named(wrap, "label")), "")
        caption = next((_xml_text(x) for x in _named(wrap, "caption")), "")
        notes = [_xml_text(n) for foot in _named(wrap, "table-wrap-foot") for n in (_named(foot, "fn") or _named(foot, "p") or [foot])]
        groups = _named(wrap, "tgroup")
        if groups:
            grids = []
            for g in groups:
                rows, _ = _cals_rows(g)
                grids.append(place_spans(rows))
            grid = grids[0]
            for more in grids[1:]:
                again = [r[0][0] for r in more] == [r[0][0] for r in grid]
                grid = [a + b[1 if again else 0 :] for a, b in zip(grid, more, strict=False)]
            explicit = any(c[1] for r in grid for c in r)
        else:
            heads = {id(x) for h in _named(wrap, "thead") for x in _named(h, "tr")}
            rows = [[(_xml_text(c), _number(c.get("rowspan")), _number(c.get("colspan")), _local(c) == "th" or id(r) in heads) for c in r if _local(c) in ("td", "th")] for r in _named(wrap, "tr")]
            grid = place_spans(rows)
            explicit = bool(heads) or bool(rows and rows[0] and all(c[3] for c in rows[0]))
        if grid:
            out.append({"label": label, "caption": " ".join(f"{label} {caption}".split()), "header_source": "explicit" if explicit else "inferred", "grid": grid, "footnotes": [n for n in notes if n]})
    return out


def _scan(docs: DataFrame, column: str, parse, needle: str = "table") -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["markup"], strict=True):
                for n, t in enumerate(parse(text) if text else []):
                    for r, row in enumerate(t["grid"]):
                        rows += [(doc, n, t["label"], t["caption"], t["header_source"], r, c, cell[0], bool(cell[1]), t["footnotes"]) for c, cell in enumerate(row)]
            yield pd.DataFrame(rows, columns=["doc_id", "table_no", "label", "caption", "header_source", "row_idx", "col_idx", "text", "is_header", "footnotes"])

    from pyspark.sql import functions as F

    # markup without a table never reaches Python
    pages = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("markup")).where(F.lower("markup").rlike(needle))
    return pages.mapInPandas(run, CELL_DDL)


def scan_html(docs: DataFrame, column: str = "html") -> DataFrame:
    """Cells of the tables in (doc_id, html), spans expanded."""
    return _scan(docs, column, html_tables)


def scan_xml(docs: DataFrame, column: str = "xml") -> DataFrame:
    """Cells of the tables in (doc_id, xml): JATS and CALS."""
    return _scan(docs, column, xml_tables)


def mixed_tables(text: str) -> list[dict]:
    """Tables of recognised text that mixes HTML and Markdown, in document order; a caption is the last label line since the table before."""
    out: list[dict] = []
    caption = ""
    for piece in re.split(r"(?is)(<table\b.*?</table>)", text or ""):
        if piece[:6].lower() == "<table":
            for t in html_tables(piece):
                label = _LABEL.match(t["caption"] or caption)
                out.append(t | {"caption": t["caption"] or caption, "label": label[1] if label else ""})
            caption = ""
            continue
        rows: list[str] = []
        for line in [*piece.split("\n"), ""]:
            s = line.strip()
            if len(s) > 1 and s[0] == "|" and s[-1] == "|":
                rows.append(s)
                continue
            if rows:
                cells = [[c.strip() for c in r[1:-1].split("|")] for r in rows]
                rule = [all(re.fullmatch(r":?-+:?", c) for c in r) and len(r) > 1 for r in cells]
                body = [r for r, skip in zip(cells, rule, strict=True) if not skip]
                width = max((len(r) for r in body), default=0)
                if body:
                    head = len(rule) > 1 and rule[1]
                    label = _LABEL.match(caption)
                    out.append({"label": label[1] if label else "", "caption": caption, "header_source": "explicit" if head else "inferred", "footnotes": [], "grid": [[(c, head and not i) for c in r + [""] * (width - len(r))] for i, r in enumerate(body)]})
                rows, caption = [], ""
            if _LABEL.match(s):
                caption = s
    return out


def scan_mixed(docs: DataFrame, column: str = "text") -> DataFrame:
    """Cells of the tables in (doc_id, text) that mixes HTML and Markdown."""
    return _scan(docs, column, mixed_tables, needle="table|\\|")

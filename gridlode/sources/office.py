"""Tables in attachments: Word documents and workbooks are zipped XML, read without any office library."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import place_spans

OFFICE_DDL = "path string, table_no int, label string, row_idx int, col_idx int, text string"


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _find(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) == name]


def docx_tables(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(caption paragraph before it, grid) of each table; spans are expanded, vertical merges repeat the cell above."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(iter(_find(ET.fromstring(z.read("word/document.xml")), "body")))
    out, caption = [], ""
    for block in body:
        text = "".join(t.text or "" for t in _find(block, "t")).strip()
        if _name(block) == "p" and text:
            caption = text
        elif _name(block) == "tbl":
            rows: list[list[tuple[str, int, int, bool]]] = []
            for row in (r for r in block if _name(r) == "tr"):
                cells = []
                for cell in (c for c in row if _name(c) == "tc"):
                    lines = ["".join(t.text or "" for t in _find(p, "t")) for p in cell if _name(p) == "p"]
                    width = next((int(_attr(g, "val") or 1) for g in _find(cell, "gridSpan")), 1)
                    merge = next((_attr(v, "val") or "continue" for v in _find(cell, "vMerge")), "")
                    cells.append(("\n".join(lines).strip() if merge != "continue" else "\x00", 1, width, False))
                rows.append(cells)
            grid = [[c[0] for c in r] for r in place_spans(rows)]
            for r in range(1, len(grid)):
                grid[r] = [grid[r - 1][c] if v == "\x00" else v for c, v in enumerate(grid[r])]
            out.append((caption, grid))
            caption = ""
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_tables(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet name, grid) of each sheet with a filled cell; values as they are stored, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in _find(s, "t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")) if _name(s) == "si"]
        titles = [_attr(s, "name") or "" for s in _find(ET.fromstring(z.read("xl/workbook.xml")), "sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for i, sheet in enumerate(sheets):
            cells: dict[tuple[int, int], str] = {}
            for r, row in enumerate(_find(ET.fromstring(z.read(sheet)), "row")):
                for k, c in enumerate(x for x in row if _name(x) == "c"):
                    value = next((v.text or "" for v in c if _name(v) == "v"), None)
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)] if value.isascii() and value.isdigit() and int(value) < len(shared) else ""
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in _find(c, "t"))
                    if value:
                        cells[int(row.get("r") or r + 1) - 1, _column(c.get("r")) if c.get("r") else k] = value
            if cells:
                top, height, width = min(r for r, _ in cells), max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
                rows = range(top, height)
                if (height - top) * width > SPARSE * len(cells) + MOST_EMPTY:  # far cells: only the rows and columns that hold something
                    rows = sorted({r for r, _ in cells})
                    place = {c: k for k, c in enumerate(sorted({c for _, c in cells}))}
                    cells, width = {(r, place[c]): v for (r, c), v in cells.items()}, len(place)
                    if len(rows) * width > SPARSE * len(cells) + MOST_EMPTY:
                        continue
                out.append((titles[i] if i < len(titles) else "", [[cells.get((r, c), "") for c in range(width)] for r in rows]))
    return out


#: A sheet's grid may have so many times its filled cells, and so many cells besides; else empty rows and columns go, and a sheet that is
#: sparse even so is no table.
SPARSE, MOST_EMPTY = 50, 100_000


def scan_office(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all tables in the .docx and .xlsx files under a path; files that are not zip archives give none."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(?:docx|xlsx)$")).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    tables = docx_tables(bytes(content)) if p.lower().endswith(".docx") else xlsx_tables(bytes(content))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration, ValueError, IndexError):
                    continue
                for n, (label, grid) in enumerate(tables):
                    rows += [(p, n, label, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)]
            yield pd.DataFrame(rows, columns=["path", "table_no", "label", "row_idx", "col_idx", "text"])

    return files.mapInPandas(run, OFFICE_DDL)

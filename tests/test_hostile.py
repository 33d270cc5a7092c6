"""Markup and sheets that were made to break a parser."""

import io
import zipfile

from pyspark.sql import functions as F

from gridlode.operators import evaluate
from gridlode.sources import markup, office


def test_hostile_spans():
    html = "<table><tr><td rowspan='²' colspan='x'>a</td><td colspan='999999999'>b</td></tr><tr><td rowspan='65534'>c</td><td>d</td></tr></table>"
    (table,) = markup.html_tables(html) if hasattr(markup, "html_tables") else [None]
    assert markup._number("²") == 1 and markup._number("-3") == 1 and markup._number(" 4 ") == 4 and markup._more("x") == 1 and markup._more("2") == 3
    grid = markup.place_spans([[("a", 10**9, 10**9, False)], [("b", 1, 1, False)]])
    assert len(grid) == 2 and len(grid[0]) <= markup.MOST_RIGHT + 1 and grid[1][-1][0] == "b"
    assert markup.place_spans([[("x", 3000, 1000, False)]] * 3000) == []


def test_bad_morerows_is_one_row():
    xml = "<r><table-wrap><label>T</label><table><tgroup><colspec colname='a'/><tbody><row><entry morerows='x'>1</entry><entry>2</entry></row><row><entry>3</entry><entry>4</entry></row></tbody></tgroup></table></table-wrap></r>"
    assert markup.xml_tables(xml)


def sheet(*cells):
    rows = "".join(f"<row r='{r}'><c r='{ref}' t='{kind}'><v>{value}</v></c></row>" for r, ref, kind, value in cells)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets><sheet name='One'/></sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>word</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_far_cells_and_bad_string_numbers():
    ((name, grid),) = office.xlsx_tables(sheet((1, "A1", "n", "5"), (1048576, "XFD1048576", "n", "6"), (2, "B2", "s", "0"), (3, "A3", "s", "77")))
    assert name == "One" and len(grid) <= 4 and {v for row in grid for v in row if v} == {"5", "6", "word"}


def test_values_and_numbers_of_the_evaluation(spark):
    df = spark.createDataFrame([("a .5 1,234 -2e3", " $1,2 "), (None, None)], "t string, v string")
    got = df.select(evaluate.loose_numbers(F.col("t")).alias("n"), evaluate.value_token(F.col("v")).alias("v"), evaluate.label_token(F.lit("Table A-1 表")).alias("l")).collect()
    assert [(r.n, r.v, r.l) for r in got] == [([0.5, 1234.0, -2000.0], "12", "tablea1"), ([], "", "tablea1")]

import io
import zipfile

from gridlode.sources import office

W = 'xmlns:w="http://w"'


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def cell(text, more=""):
    return f"<w:tc>{more}<w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


DOCX = packed({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Table S1. Rocks</w:t></w:r></w:p><w:tbl><w:tr>{cell('Id', '<w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>')}{cell('x')}</w:tr><w:tr>{cell('1', '<w:tcPr><w:vMerge w:val=\"restart\"/></w:tcPr>')}{cell('a')}{cell('b')}</w:tr><w:tr>{cell('', '<w:tcPr><w:vMerge/></w:tcPr>')}{cell('c')}{cell('d')}</w:tr></w:tbl></w:body></w:document>"})
XLSX = packed({
    "xl/workbook.xml": '<workbook><sheets><sheet name="Data"/><sheet name="Empty"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>Sample</t></si><si><r><t>Q</t></r><r><t>ty</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>A</t></is></c><c r="C3"><v>007</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
})


def test_parsers():
    assert office.docx_tables(DOCX) == [("Table S1. Rocks", [["Id", "Id", "x"], ["1", "a", "b"], ["1", "c", "d"]])]
    assert office.xlsx_tables(XLSX) == [("Data", [["Sample", "", "Qty"], ["A", "", "007"]])]


def test_folder_of_attachments(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.xlsx").write_bytes(XLSX)
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    (tmp_path / "d.txt").write_bytes(b"x")
    got = office.scan_office(spark, str(tmp_path)).collect()
    assert len(got) == 15 and {r.path.rsplit("/", 1)[-1] for r in got} == {"a.docx", "b.xlsx"}

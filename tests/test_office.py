import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from quaywise.operators import retrieval
from quaywise.plans.search import office_rows
from quaywise.session import read
from quaywise.sources import files, office

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def book(rows, strings=(), formats=(), date1904=False, target="worksheets/data.xml", more=""):
    """A workbook as spreadsheet programs write it: shared strings, styles, a second sheet."""
    return packed(
        {
            "xl/workbook.xml": f'<workbook {NS} xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="Data" sheetId="1" r:id="rId7"/><sheet name="Other" sheetId="2" r:id="rId8"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId8" Type="x" Target="/xl/other.xml"/><Relationship Id="rId7" Type="x" Target="{target}"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {NS}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>",
            "xl/styles.xml": f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy;@"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/><numFmt numFmtId="166" formatCode="[Red]0.0"/></numFmts>'
            f"<cellXfs>{''.join(f'<xf numFmtId=\"{n}\"/>' for n in formats)}</cellXfs></styleSheet>",
            "xl/worksheets/data.xml": f"<worksheet {NS}><sheetData>{rows}</sheetData>{more}</worksheet>",
            "xl/other.xml": f'<worksheet {NS}><sheetData><row><c t="str"><v>else</v></c></row></sheetData></worksheet>',
        }
    )


CELLS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row>'
    '<row r="2"><c r="A2" s="1"><v>45000</v></c><c r="B2"><v>12</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="e"><v>#N/A</v></c></row>'
    '<row r="4"><c r="A4" s="2"><v>45000.75</v></c><c r="B4" s="3"><v>1.5</v></c><c r="C4" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r><rPh><t>x</t></rPh></is></c><c r="AA4" t="str"><v>far</v></c></row>'
    '<row r="5"><c r="A5"/><c r="B5" t="s"><v>2</v></c></row><row r="6"/>'
)
STRINGS = ("<t>Date d'achat</t>", "<r><t>Stock</t></r><r><t>-qty</t></r>", "<t></t>")
FORMATS = (0, 14, 164, 165, 166)


def as_files(spark, some):
    return spark.createDataFrame([(f"/in/{n}", bytearray(c)) for n, c in some.items()], "path string, content binary")


def test_cells(spark):
    rows = {r.line: r.cells for r in office.sheet_rows(as_files(spark, {"a.xlsx": book(CELLS, STRINGS, FORMATS)})).collect()}
    assert rows == {
        1: ["Date d'achat", "Stock-qty", None, "Date d'achat"],
        2: ["2023-03-15", "12", "true", None],
        4: ["2023-03-15 18:00:00", "1.5", "inline", *[None] * 23, "far"],
    }
    later = office.sheet_rows(as_files(spark, {"a.xlsx": book('<row><c s="1"><v>1</v></c><c><v>1e20</v></c></row>', formats=FORMATS, date1904=True)})).first()
    assert later.cells == ["1904-01-02", "1e+20"] and later.line == 1
    both = office.sheet_rows(as_files(spark, {"a.xlsx": book(CELLS, STRINGS, FORMATS)}), sheet=None).where("sheet = 'Other'").collect()
    assert [(r.line, r.cells) for r in both] == [(1, ["else"])]


def test_damaged_files_are_rows_with_an_error(spark):
    good = book(CELLS, STRINGS, FORMATS)
    bad = {
        "cut.xlsx": good[: len(good) // 2],
        "empty.xlsx": b"",
        "text.xlsx": b"a;b\n1;2",
        "old.xlsx": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 600,
        "old.xls": b"\xd0\xcf\x11\xe0",
        "half.xlsx": book(CELLS + "<row><c><v>1</v>", STRINGS, FORMATS),
        "number.xlsx": book(CELLS + "<row><c><v>one</v></c></row>", STRINGS, FORMATS),
        "string.xlsx": book('<row><c t="s"><v>9</v></c></row>'),
        "lost.xlsx": book(CELLS, STRINGS, FORMATS, target="nowhere.xml"),
        "x.docx": good,
    }
    got = office.sheet_rows(as_files(spark, bad | {"good.xlsx": good})).collect()
    errors = {r.path.removeprefix("/in/"): r for r in got if r.error}
    assert set(errors) == set(bad) and all(r.cells is None for r in errors.values())
    assert sum(r.path == "/in/good.xlsx" for r in got) == 3


def test_uploads_are_read_like_csv(spark, tmp_path):
    (tmp_path / "up.xlsx").write_bytes(book(CELLS, STRINGS, FORMATS))
    df = files.read_table(spark, str(tmp_path / "up.xlsx"))
    assert df.columns == ["DATE_D'ACHAT", "STOCK_QTY", "UNNAMED:_2", "DATE_D'ACHAT_1", files.LINE]
    assert [tuple(r)[:4] for r in df.orderBy(files.LINE).collect()] == [("2023-03-15", "12", "true", None), ("2023-03-15 18:00:00", "1.5", "inline", None)]
    sales = office.workbook(["Creation Date", "MSISDN", "Offre"], [("2026-01-02", 21620123456, "Fibre 100"), ("2026-01-03", 21620123457, "5G Box"), (None, None, None)])
    (tmp_path / "sales.xlsx").write_bytes(sales)
    frame = files.sales_frame(files.read_table(spark, str(tmp_path / "sales.xlsx")))
    assert frame.count() == 2 and files.kind_of(["CREATION_DATE", "MSISDN", "OFFRE"]) == "sales"
    for name, content in (("bad.xlsx", b"no"), ("old.xls", b"\xd0\xcf\x11\xe0")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(ValueError):
            files.read_table(spark, str(tmp_path / name))


def test_workbooks_come_back_row_for_row(spark, tmp_path):
    rows = [(i, f"<name & {i}>  x", None if i % 7 == 0 else i / 8, i % 2 == 0, datetime.date(2024, 1, 1 + i % 28), "é\t漢\n😀" if i % 5 else "") for i in range(250)]
    df = spark.createDataFrame(rows, "id long, name string, x double, flag boolean, day date, note string").repartition(3)
    for r in office.workbooks(df, rows=40).collect():
        (tmp_path / r.path).write_bytes(r.content)
    back = office.sheet_rows(office.files(spark, str(tmp_path)))
    assert back.where("line = 1").count() == len(list(tmp_path.iterdir())) >= 7 and back.where("error IS NOT NULL").count() == 0
    got = office.table(back.where("line > 1"), df.columns).select(F.col("id").cast("long"), "name", F.col("x").cast("double"), F.col("flag").cast("boolean"), F.col("day").cast("date"), "note")
    assert sorted(map(tuple, got.collect())) == rows


def document(body):
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def test_documents(spark, tmp_path):
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = (
        f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr>{run('One ')}{run('line')}<w:r><w:tab/><w:t>é</w:t><w:br/></w:r><w:hyperlink>{run('link')}</w:hyperlink></w:p><w:p/>"
        f"<w:tbl><w:tr><w:tc><w:p>{run('cell')}</w:p></w:tc></w:tr></w:tbl>"
        f"<w:p>{run('kept')}<w:del>{run('gone')}</w:del><w:ins>{run(' new')}</w:ins></w:p><w:sectPr/>"
    )
    for name, content in {"a.docx": document(body), "b.docx": b"PK\3\4 no", "c.txt": "é ok".encode() + b"\xff!", "d.pdf": b"%PDF", "e.MD": b"# T", "f.docx": document("")}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.source: r for r in retrieval.read_documents(spark, str(tmp_path)).collect()}
    assert {n: r.text for n, r in got.items()} == {"a.docx": "One line\té\nlink\n\nkept new", "b.docx": "", "c.txt": "é ok!", "d.pdf": "", "e.MD": "# T", "f.docx": ""}
    assert {n for n, r in got.items() if r.error} == {"b.docx", "d.pdf"} and got["e.MD"].doc_type == "md"


def test_query_over_the_whole_table(spark):
    assert office_rows(spark, "/root/testdata/sf0.001").count() == read(spark, "/root/testdata/sf0.001", "customer").count()

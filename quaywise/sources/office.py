"""Workbooks (.xlsx, .xlsm) and text documents (.docx) as Spark sources, and tables as workbooks.

Files come as rows of Spark's binary file source, or of any table with `path` and `content`, so that whatever store Spark reads
will do; a task takes one file after the other. Both kinds are ZIP archives of XML parts. A part is unpacked and parsed
as a stream: of a sheet one row is held at a time, besides the workbook's table of shared strings. A file that is damaged,
encrypted, or of another kind gives one row that says why in `error`, and no other: it is parsed to its end before its
first row is given out.

Cells become strings as uploads in CSV have them: whole numbers without a fraction, dates (numbers whose format is one
of a date) as yyyy-MM-dd, with HH:mm:ss where the time isn't midnight, booleans as true and false; errors and empty
cells are null. Rows without any value are left out. Files of the old binary kind (.xls, .doc) and .pdf have no reader here.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: namespaces, numbers of the built-in formats of dates, kinds of files.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
TEXTS, WORKBOOKS, DOCUMENTS = ("txt", "md", "csv", "log"), ("xlsx", "xlsm"), ("docx",)
#: Rows of an Arrow batch.
BATCH = 2000

_FAULTS = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, IndexError, OSError, RuntimeError, NotImplementedError)
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of a file, or of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def _elements(part: io.BufferedIOBase, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one at a time; what was read before is forgotten."""
    path: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if e.tag == tag:
            yield e
        if path and not any(p.tag == tag for p in path):
            path[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    """The text of a string item: its runs, without the phonetic ones."""
    return "".join(t.text or "" for child in e for t in ([child] if child.tag == f"{MAIN}t" else child.iter(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))


def _is_date(code: str) -> bool:
    return bool(re.search("[ymdhs]", _QUOTED.sub("", code.split(";")[0]), re.I)) and "general" not in code.lower()


def _column(ref: str) -> int:
    """The number of a cell's column, from 0 on: A1 is in 0, AA1 in 26."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """What the cells of a workbook's sheets need: shared strings, which styles are dates, the day that numbers count from."""

    def __init__(self, archive: zipfile.ZipFile) -> None:
        self.archive = archive
        names = set(archive.namelist())
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        properties = book.find(f"{MAIN}workbookPr")
        later = properties is not None and properties.get("date1904", "0") in ("1", "true")
        self.start = datetime.datetime(1904, 1, 1) if later else datetime.datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = [(s.get("name"), self._place(targets[s.get(LINK)])) for s in book.iter(f"{MAIN}sheet")]
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with archive.open("xl/sharedStrings.xml") as part:
                self.strings = [_text(e) for e in _elements(part, f"{MAIN}si")]
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(archive.read("xl/styles.xml"))
            own = {f.get("numFmtId"): _is_date(f.get("formatCode") or "") for f in styles.iter(f"{MAIN}numFmt")}
            self.dates = [own.get(x.get("numFmtId"), int(x.get("numFmtId") or 0) in DATE_FORMATS) for x in styles.findall(f"{MAIN}cellXfs/{MAIN}xf")]

    @staticmethod
    def _place(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            item = cell.find(f"{MAIN}is")
            return _text(item) if item is not None else None
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "true" if v.text.strip() == "1" else "false"
        if kind in ("str", "d"):
            return v.text
        x, style = float(v.text), int(cell.get("s", "0"))
        if style < len(self.dates) and self.dates[style]:
            at = self.start + datetime.timedelta(seconds=round(x * 86400))
            return at.isoformat(" ") if at.time() != datetime.time() else at.date().isoformat()
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)

    def rows(self, place: str) -> Iterator[tuple[int, list[str | None]]]:
        """Number and cells of every row of a sheet that has a value."""
        with self.archive.open(place) as part:
            number = 0
            for row in _elements(part, f"{MAIN}row"):
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self._value(c)
                if any(x not in (None, "") for x in cells):
                    yield number, cells


def _sheet_rows(content: bytes, sheet: int | None) -> Iterator[tuple[str, int, list[str | None]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        book = Workbook(archive)
        for name, place in book.sheets if sheet is None else book.sheets[sheet : sheet + 1]:
            for number, cells in book.rows(place):
                yield name, number, cells


def _fault(path: str, content: bytes, kinds: tuple[str, ...]) -> str | None:
    """Why a file can't be of these kinds, by its name or its first bytes."""
    kind = path.rpartition(".")[2].lower()
    if kind not in kinds:
        return f"files of type {kind} can't be read"
    return "an old binary or encrypted file" if content[:4] == b"\xd0\xcf\x11\xe0" else None


_SHEET_ROWS = [("path", pa.string()), ("sheet", pa.string()), ("line", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())]


def sheet_rows(found: DataFrame, sheet: int | None = 0) -> DataFrame:
    """path, sheet, line, cells and error for every row of the workbooks among files (path, content): of the sheet of that number,
    or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in ((p, c) for b in batches for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            error = _fault(path, content or b"", WORKBOOKS)
            try:
                for _ in () if error else _sheet_rows(content, sheet):
                    pass
            except _FAULTS as e:
                error = f"{type(e).__name__}: {e}"
            if error:
                yield _batch(_SHEET_ROWS, [(path, None, None, None, error)])
                continue
            held = []
            for name, number, cells in _sheet_rows(content, sheet):
                held.append((path, name, number, cells, None))
                if len(held) == BATCH:
                    yield _batch(_SHEET_ROWS, held)
                    held = []
            if held:
                yield _batch(_SHEET_ROWS, held)

    return found.select("path", "content").mapInArrow(run, "path string, sheet string, line int, cells array<string>, error string")


def _batch(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def table(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of sheets as a table with columns of these names, in the order of the cells; null where a row has fewer."""
    return rows.where("error IS NULL").select("path", "line", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def headings(cells: list[str | None]) -> list[str]:
    """Names of columns from a heading row: those without one are numbered, repeated ones get a number behind them."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name, n = c if c not in (None, "") else f"Unnamed: {i}", 0
        while name in out:
            n += 1
            name = f"{c}.{n}"
        out.append(name)
    return out


def document_text(content: bytes) -> str:
    """The paragraphs of a text document's body, a line each; tables, notes and what was deleted aside."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as part:
        depth, now, skip = [], None, 0
        for event, e in ElementTree.iterparse(part, events=("start", "end")):
            tag = e.tag.removeprefix(WORD)
            if event == "start":
                if tag == "p" and depth and depth[-1].tag == f"{WORD}body":
                    now = []
                skip += tag in ("del", "moveFrom", "txbxContent", "pPr")
                depth.append(e)
                continue
            depth.pop()
            skip -= tag in ("del", "moveFrom", "txbxContent", "pPr")
            if now is not None and not skip:
                now.append({"t": e.text or "", "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(tag, ""))
            if tag == "p" and depth and depth[-1].tag == f"{WORD}body":
                out.append("".join(now or []))
                now = None
                depth[-1].remove(e)
    return "\n".join(out)


_DOCUMENTS = [("source", pa.string()), ("doc_type", pa.string()), ("text", pa.string()), ("error", pa.string())]


def documents(found: DataFrame) -> DataFrame:
    """source (name of the file), doc_type, text and error of files (path, content).

    Text files are decoded as UTF-8 without what can't be; a file that has no reader or is damaged has an empty text and an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in ((p, c) for b in batches for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            kind, text = path.rpartition(".")[2].lower(), ""
            error = _fault(path, content or b"", TEXTS + DOCUMENTS)
            try:
                if not error:
                    text = (content or b"").decode("utf-8", "ignore") if kind in TEXTS else document_text(content)
            except _FAULTS as e:
                error = f"{type(e).__name__}: {e}"
            yield _batch(_DOCUMENTS, [(path.rpartition("/")[2], kind, text, error)])

    return found.select("path", "content").mapInArrow(run, "source string, doc_type string, text string, error string")


# Fixed texts of the format: the parts of a workbook with one sheet.
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELATION = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/%s" Target="%s"/></Relationships>'
_BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name=%s sheetId="1" r:id="rId1"/></sheets></workbook>'
#: Characters that XML can't hold.
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, k = divmod(i - 1, 26)
        out = chr(65 + k) + out
    return out


def workbook(names: list[str], rows: list[tuple], sheet: str = "Sheet1") -> bytes:
    """A workbook with one sheet: a heading row and the rows; numbers as numbers, booleans as such, everything else as text."""

    def cell(at: str, x: object) -> str:
        if x is None or isinstance(x, float) and x != x:
            return ""
        if isinstance(x, bool):
            return f'<c r="{at}" t="b"><v>{int(x)}</v></c>'
        if isinstance(x, int | float) and abs(x) < 1e15:
            return f'<c r="{at}"><v>{x!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNWRITABLE.sub("", str(x)), {chr(13): "&#13;"})}</t></is></c>'

    letters, out = [_letters(i) for i in range(len(names))], io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for place, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATION % ("officeDocument", "xl/workbook.xml")), ("xl/workbook.xml", _BOOK % quoteattr(sheet)), ("xl/_rels/workbook.xml.rels", _RELATION % ("worksheet", "worksheets/sheet1.xml"))):
            archive.writestr(place, text)
        with archive.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for n, row in enumerate([names, *rows], 1):
                part.write(f'<row r="{n}">{"".join(cell(f"{c}{n}", x) for c, x in zip(letters, row, strict=True))}</row>'.encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(df: DataFrame, rows: int = 50_000, prefix: str = "part") -> DataFrame:
    """df as workbooks (path, content) of so many rows at most, next to where the rows are: nothing is shuffled."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held = TaskContext.get().partitionId(), 0, []
        for b in batches:
            for start in range(0, b.num_rows, BATCH):
                held += zip(*(c.to_pylist() for c in b.slice(start, BATCH).columns), strict=True)
                while len(held) >= rows:
                    yield _batch(kinds, [(f"{prefix}-{at:05d}-{number:05d}.xlsx", workbook(names, held[:rows]))])
                    held, number = held[rows:], number + 1
        if held:
            yield _batch(kinds, [(f"{prefix}-{at:05d}-{number:05d}.xlsx", workbook(names, held))])

    kinds = [("path", pa.string()), ("content", pa.binary())]
    return df.mapInArrow(run, "path string, content binary")

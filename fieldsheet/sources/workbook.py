"""Workbooks: reading .xlsx into cells, writing report sheets as .xlsx.

``read_cells`` reads whole files by Spark and parses them in Arrow batches, so a folder of
workbooks in any store is read by many tasks. Dates stay serial numbers,
formulas give their stored values, error cells and empty ones give no row.
Legacy .xls is read too. A file that can't be read gives one row with a note, never silence.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterable, Iterator
from html import escape
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from . import xls

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
SCHEMA = "file_name string, sheet_ord int, sheet_name string, addr string, col string, row_no int, kind string, num double, txt string, note string"
ACCEPTED = r"(?i)\.(xls|xlsx|xlsm)$"


def read_workbook(name: str, data: bytes) -> Iterator[tuple]:
    """The cells of one file as rows of ``SCHEMA``."""
    try:
        yield from list(_read_zip(name, data) if data.startswith(b"PK") else _read_legacy(name, data))
    except (xls.Unreadable, zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, TypeError, AttributeError, struct.error) as x:
        yield (name, None, None, None, None, None, None, None, None, f"can't be read: {x}")


def _read_legacy(name: str, data: bytes) -> Iterator[tuple]:
    for i, sheet, r, c, v in xls.cells(data):
        col, text = column_name(c + 1), isinstance(v, str)
        yield (name, i, sheet, f"{col}{r + 1}", col, r + 1, "s" if text else "n", None if text else v, v if text else None, None)


def _read_zip(name: str, data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        have = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in have:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                # Readings of characters (phonetic runs) are no part of the text.
                shared.append("".join(t.text or "" for x in si if x.tag != f"{MAIN}rPh" for t in x.iter(f"{MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        for i, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
            path = targets[s.get(f"{REL}id")].lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            for addr, col, row, c in _cells(ElementTree.fromstring(z.read(path))):
                kind = c.get("t", "n")
                v = c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif v is None or v.text is None or kind == "e":
                    continue
                else:
                    value = shared[int(v.text)] if kind == "s" else ("false", "true")[v.text == "1"] if kind == "b" else v.text
                if kind == "n":
                    yield (name, i, s.get("name"), addr, col, row, "n", float(value), None, None)
                else:
                    yield (name, i, s.get("name"), addr, col, row, "s", None, value, None)


def _cells(sheet: ElementTree.Element) -> Iterator[tuple]:
    """``addr, col, row, cell``; a row or cell without an address follows the one before it."""
    row = 0
    for r in sheet.iter(f"{MAIN}row"):
        row, n = int(r.get("r") or row + 1), 0
        for c in r.iter(f"{MAIN}c"):
            col = re.match(r"[A-Z]+", c.get("r") or column_name(n + 1))[0]
            n = 0
            for x in col:
                n = n * 26 + ord(x) - 64
            yield f"{col}{row}", col, row, c


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks under ``path`` (any store that Spark reads), with a sheet id made of
    the file's whole path and the sheet, so that it is the same in every run and another folder's isn't."""
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        names = ["path", *[x.split()[0] for x in SCHEMA.split(", ")]]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()]
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = [(name, *r) for r in read_workbook(name.rpartition("/")[2], data.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(ACCEPTED))
    return files.select("path", "content").mapInArrow(run, "path string, " + SCHEMA).withColumn("sheet_id", F.xxhash64("path", "sheet_name")).drop("path")


def column_name(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


#: Styles by cell type: text, number, date (format 14), time (format 20); 4 is the header.
STYLES = {"s": 0, "n": 1, "d": 2, "tm": 3}


def _text(v) -> str:
    return escape(str(v), {'"': "&quot;", "\r\n": "&#10;", "\n": "&#10;"})


def _sheet(header: list[str], rows: Iterable[list], widths: dict[str, float]) -> str:
    def cell(r: int, i: int, t: str, v) -> str:
        at, style = f'{column_name(i)}{r}', 4 if r == 1 else STYLES[t]
        if v is None or v == "":
            return f'<c r="{at}" s="{style}"/>'
        if t == "s":
            return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_text(v)}</t></is></c>'
        return f'<c r="{at}" s="{style}"><v>{v!r}</v></c>'

    lines, widest, n = [], len(header), 1
    lines.append("<row r='1'>" + "".join(cell(1, i, "s", h) for i, h in enumerate(header, 1)) + "</row>")
    for n, row in enumerate(rows, 2):
        widest = max(widest, len(row))
        lines.append(f"<row r='{n}'>" + "".join(cell(n, i, t, v) for i, (t, v) in enumerate(row, 1)) + "</row>")
    at = {column_name(i): i for i in range(1, widest + 1)}
    cols = "".join(f'<col min="{at[c]}" max="{at[c]}" width="{w}" customWidth="1"/>' for c, w in widths.items() if c in at)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><dimension ref="A1:{column_name(max(widest, 1))}{n}"/>{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(lines)}</sheetData></worksheet>'


def write_workbook(sheets: list[tuple[str, list[str], Iterable[list]]], widths: dict[str, dict[str, float]] | None = None) -> bytes:
    """Sheets of ``(name, header, rows)``; a row is a list of ``(type, value)``; ``widths`` are those of a sheet's
    columns by letter. Equal input gives equal bytes: entries are stored with a fixed time."""
    xml = '<?xml version="1.0" encoding="UTF-8"?>'
    formats = "".join(f'<xf numFmtId="{f}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for f in (0, 0, 14, 20, 0))
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'{xml}<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{xml}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _, _) in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{xml}<Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{i}" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        + f'<Relationship Id="rId{len(sheets) + 1}" Type="{REL[1:-1]}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{xml}<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="1"><font><sz val="12"/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5">{formats}</cellXfs></styleSheet>',
    } | {f"xl/worksheets/sheet{i}.xml": _sheet(h, rows, (widths or {}).get(n, {})) for i, (n, h, rows) in enumerate(sheets, 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), text.encode())
    return out.getvalue()


def file_name(label: str, project: str | None, day: str) -> str:
    """``<label>_<project>_<yyyymmdd>.xlsx``."""
    return f"{label}_{project or '未設定案場'}_{day.replace('-', '')}.xlsx"


def report_workbook(report: DataFrame, header: list[str], types: list[str], sheet_name: str, basic: list[list] | None = None, basic_header: list[str] | None = None) -> bytes:
    """A report's rows as a workbook. Rows come to the driver one partition at a time; a report that a
    person opens in a spreadsheet is small, larger ones are written as Parquet."""
    rows = ([(t if v is not None else "s", v) for t, v in zip(types, r, strict=True)] for r in report.toLocalIterator())
    sheets = [("監測點基本資料", basic_header or [], [[("s", v) for v in r] for r in basic or []]), (sheet_name, header, rows)]
    return write_workbook(sheets)

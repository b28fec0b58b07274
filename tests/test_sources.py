import pytest
from pyspark.sql import functions as F

from fieldsheet.operators import extract, master, report
from fieldsheet.sources import workbook
from fieldsheet.sources.store import Store
from fieldsheet.streaming import ingest


def test_workbook_round_trip(spark, tmp_path):
    rows = [[("s", "示範站 <a>&"), ("n", 2.5), ("d", 46058), ("tm", 0.5), ("s", None)], [("s", "x"), ("n", 3), ("s", ""), ("n", None), ("s", "y")]]
    data = workbook.write_workbook([("監測點", ["a"], []), ("items", ["h1", "h2"], rows)])
    assert data == workbook.write_workbook([("監測點", ["a"], []), ("items", ["h1", "h2"], rows)])
    (tmp_path / "r.xlsx").write_bytes(data)
    (tmp_path / "old.XLS").write_bytes(b"\xd0\xcf\x11\xe0")
    (tmp_path / "note.txt").write_bytes(b"x")
    got = workbook.read_cells(spark, str(tmp_path)).collect()
    cells = {(r.sheet_name, r.addr): r.txt if r.kind == "s" else r.num for r in got if r.addr}
    assert cells == {("監測點", "A1"): "a", ("items", "A1"): "h1", ("items", "B1"): "h2", ("items", "A2"): "示範站 <a>&", ("items", "B2"): 2.5, ("items", "C2"): 46058.0, ("items", "D2"): 0.5, ("items", "A3"): "x", ("items", "B3"): 3.0, ("items", "E3"): "y"}
    assert [r.file_name for r in got if r.note] == ["old.XLS"]
    assert workbook.file_name("水質", None, "2026-02-05") == "水質_未設定案場_20260205.xlsx"


def legacy_workbook(mini: bool) -> bytes:
    """A BIFF8 workbook in a compound file, written by hand: one sheet with every kind of cell."""
    import struct

    rec = lambda kind, body: struct.pack("<2H", kind, len(body)) + body
    bof = rec(0x809, struct.pack("<4H2I", 0x600, 5, 0, 0, 0, 0))
    texts = ["監測地點：一", "plain", "cut in two by a continuation " * 3]
    sst = struct.pack("<2I", 3, 3)
    for t in texts[:2]:
        wide = not t.isascii()
        sst += struct.pack("<HB", len(t), wide) + t.encode("utf-16-le" if wide else "latin-1")
    t = texts[2]
    sst += struct.pack("<HB", len(t), 0) + t[:20].encode()
    shared = rec(0xFC, sst) + rec(0x3C, b"\x01" + t[20:].encode("utf-16-le"))
    at = lambda r, c: struct.pack("<3H", r, c, 0)
    sheet = bof + rec(0xFD, at(0, 0) + struct.pack("<I", 0)) + rec(0xFD, at(0, 1) + struct.pack("<I", 2)) + rec(0x203, at(1, 0) + struct.pack("<d", 2.5))
    sheet += rec(0x27E, at(1, 1) + struct.pack("<I", (300 << 2) | 3)) + rec(0xBD, struct.pack("<2H", 2, 0) + struct.pack("<HIHI", 0, (7 << 2) | 2, 0, ((-4 << 2) & 0xFFFFFFFF) | 2) + struct.pack("<H", 1))
    sheet += rec(0x06, at(3, 0) + struct.pack("<d", 9.75) + b"\0" * 8) + rec(0x06, at(3, 1) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + rec(0x207, struct.pack("<HB", 2, 0) + b"ok")
    sheet += rec(0x204, at(4, 27) + struct.pack("<HB", 1, 0) + b"L") + rec(0x205, at(5, 0) + b"\x01\x00") + rec(0x205, at(5, 1) + b"\x2a\x01") + rec(0x0A, b"")
    head = lambda pos: bof + rec(0x85, struct.pack("<IH", pos, 0) + struct.pack("<BB", 2, 1) + "空品".encode("utf-16-le")) + shared + rec(0x0A, b"")
    book = head(len(head(0))) + sheet
    if not mini:
        book += b"\0" * (5000 - len(book))
    pad = lambda b, n: b + b"\0" * (-len(b) % n)
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    body = pad(pad(book, 64), 512)
    n = len(body) // 512
    entry = lambda name, kind, start, size: pad(name.encode("utf-16-le"), 64)[:64].ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<2I", start, size) + b"\0" * 4
    # Sectors: 0 FAT, 1 directory, 2 small FAT, 3.. the stream (or the root's small sectors).
    fat = [0xFFFFFFFD, end, end] + [3 + i + 1 for i in range(n - 1)] + [end]
    small = [i + 1 for i in range(len(pad(book, 64)) // 64 - 1)] + [end]
    directory = entry("Root Entry", 5, 3 if mini else end, n * 512 if mini else 0) + entry("Workbook", 2, 0 if mini else 3, len(book)) + b"\0" * 256
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 2 if mini else end, 1 if mini else 0, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    ints = lambda v: struct.pack("<128I", *(v + [free] * (128 - len(v))))
    return header + ints(fat) + directory + ints(small) + body


@pytest.mark.parametrize("mini", [True, False])
def test_legacy_workbook(mini):
    got = {r[3]: r[8] if r[6] == "s" else r[7] for r in workbook.read_workbook("a.xls", legacy_workbook(mini))}
    assert got == {"A1": "監測地點：一", "B1": "cut in two by a continuation " * 3, "A2": 2.5, "B2": 3.0, "A3": 7.0, "B3": -4.0, "A4": 9.75, "B4": "ok", "AB5": "L", "A6": "true"}
    assert next(workbook.read_workbook("a.xls", legacy_workbook(mini)[:700]))[9].startswith("can't be read")


WATER = [("A2", "第036號"), ("A3", "水質檢測報告"), ("F8", "示範站放流口"), ("B11", "河川水"), ("J9", 115.0), ("K9", 2.0), ("L9", 5.0), ("M9", 10.0), ("N9", 43.0),
         ("A15", "溶氧"), ("C15", 6.5), ("D15", "--"), ("E15", "mg/L"), ("F15", "NIEA W455.52C"), ("A16", "大腸桿菌群"), ("C16", "6.0×104"), ("E16", "CFU/100mL"), ("F16", "NIEA E202.55B"), ("A17", "備註：x"), ("A18", "後")]


def cells(spark, sheet, extra=()):
    import re

    rows = [(sheet, a, *re.match(r"([A-Z]+)(\d+)", a).groups(), v if isinstance(v, float) else None, v if isinstance(v, str) else None) for a, v in [*WATER, *extra]]
    return spark.createDataFrame([(s, a, c, int(r), n, t) for s, a, c, r, n, t in rows], "sheet_id long, addr string, col string, row_no int, num double, txt string")


def test_water_sheet(spark):
    c = cells(spark, 1)
    stations = spark.createDataFrame([(1, "示範站", 3, 200000.0, None, "10:30", ["示範站放流口"]), (2, "示範站放流口", 1, 1.0, 1.0, None, [])], "ord long, name string, coord_sys int, x double, y double, last_end_time string, aliases array<string>")
    none = F.lit(None)
    h = extract.water_heads(c).withColumns({"coord_sys": none.cast("int"), "x": none.cast("double"), "y": none.cast("double"), "time_end": none.cast("string")})
    r = master.match_station(h, stations)
    assert tuple(r.select("site", "category", "date_start", "time_start", "license", "coord_sys", "x", "y").first()) == ("示範站", "河川", "2026-02-05", "10:43", 36, 3, 200000.0, None)
    items = extract.water_items(c)
    assert [tuple(x) for x in items.orderBy("item_idx").select("item_name", "unit_code", "value_num", "mdl_txt", "method_out").collect()] == [("溶氧", 47, 6.5, None, "NIEA W422"), ("大腸桿菌群", 8, 60000.0, None, "NIEA E202")]
    missing = {(x.item_idx, x.key) for x in report.missing(r, items, "water").collect()}
    assert missing == {(None, "time_end"), (None, "y")}


def test_report_workbook(spark):
    c = cells(spark, 1)
    r = report.flatten(extract.water_heads(c), extract.water_items(c)).orderBy("item_idx").select("station_raw", F.col("value_num"), report.cell_type("d", F.lit(None).cast("double"), F.col("date_start"))["v"].alias("d"), "compare")
    data = workbook.report_workbook(r, ["site", "value", "date", "compare"], ["s", "n", "d", "s"], "水質檢測項目", basic=[["P1", None]], basic_header=["code", "no"])
    got = {(x[2], x[3]): x[8] if x[6] == "s" else x[7] for x in workbook.read_workbook("r.xlsx", data)}
    assert got[("水質檢測項目", "A2")] == "示範站放流口" and got[("水質檢測項目", "B3")] == 60000.0 and got[("水質檢測項目", "C2")] == 46058.0 and ("水質檢測項目", "D2") not in got
    assert got[("監測點基本資料", "A2")] == "P1" and got[("監測點基本資料", "B1")] == "no"


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([("a", 1.5, ["x"]), ("b", None, [])], "name string, x double, aliases array<string>")
    assert s.seed("stations", rows) and not s.seed("stations", rows)
    s.put("stations", spark.createDataFrame([("b", 2.0, ["y"]), ("c", 3.0, [])], rows.schema))
    assert [r.name for r in s.get_all("stations").collect()] == ["a", "b", "c"] and s.get("stations", "b").first().x == 2.0
    s.put("settings", spark.createDataFrame([("active", "P1")], "key string, value string"))
    assert s.setting("active") == "P1" and s.setting("none") is None
    text = s.backup()
    s.delete("stations", "a")
    s.clear("settings")
    assert s.get_all("stations").count() == 2
    s.restore(text)
    assert [(r.name, r.x, r.aliases) for r in s.get_all("stations").collect()] == [("a", 1.5, ["x"]), ("b", 2.0, ["y"]), ("c", 3.0, [])] and s.setting("active") == "P1"
    with pytest.raises(ValueError):
        s.restore('{"app": "other"}')


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    cells(spark, 1).coalesce(1).write.parquet(f"{src}/a")
    for new, total in ((None, 1), (2, 1)):
        if new:
            cells(spark, new).coalesce(1).write.parquet(f"{src}/b")
        ingest.start(spark, f"{src}/*", out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == total  # the same site and day again is skipped


def test_merge_and_overlay_properties(spark):
    t = lambda *k: spark.createDataFrame([(x, f"{x}-v") for x in k], "k string, v string")
    merged = {r.k: r.added for r in master.merge_tables(t("own", "both"), t("deleted", "both"), t("deleted", "both", "new")).collect()}
    assert merged == {"own": False, "both": False, "new": True}
    ed = spark.createDataFrame([("u", "k", None, 2), ("u", "k", "v1", 1)], "uid string, key string, new_value string, seq long")
    it = spark.createDataFrame([("u", "k", "old", "parsed"), ("u", "j", "old", "parsed")], "uid string, key string, value string, src string")
    assert {(r.key, r.value, r.src) for r in master.overlay(it, ed).collect()} == {("k", None, "manual"), ("j", "old", "parsed")}


def test_cells_without_addresses(spark, tmp_path):
    """Cells follow one another where addresses are left out, readings aren't text, damage is a note, and equal
    names in two folders are two files."""
    import zipfile

    from fieldsheet.sources import workbook

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def write(path, sheet):
        path.parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>水</t><rPh sb='0' eb='1'><t>スイ</t></rPh></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")

    rows = '<row><c t="s"><v>0</v></c><c><v>2</v></c></row><row r="5"><c r="C5" t="s"><v>1</v></c><c><v>7</v></c></row><row><c><v>9</v></c></row>'
    write(tmp_path / "one" / "w.xlsx", rows)
    write(tmp_path / "two" / "w.xlsx", rows)
    write(tmp_path / "two" / "bad.xlsx", '<row><c r="A1"><v>no number</v></c></row>')
    got = workbook.read_cells(spark, str(tmp_path / "*")).collect()
    want = {("A1", None, "水"), ("B1", 2.0, None), ("C5", None, "ab"), ("D5", 7.0, None), ("A6", 9.0, None)}
    assert {(x.addr, x.num, x.txt) for x in got if not x.note} == want
    assert len({x.sheet_id for x in got if not x.note}) == 2
    assert [x.file_name for x in got if x.note] == ["bad.xlsx"]

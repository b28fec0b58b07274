"""Reports as workbooks, one a module: the project sheet and the item sheet with their fixed headers.

A report that a person opens in a spreadsheet is small: its rows come to the driver one
partition at a time. Larger ones are written as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import COLUMNS, ColumnMeta, cell_type
from .workbook import file_name, write_workbook

# Labels, sheet names, headers and column widths of the official templates.
LABELS = {"water": "水質檢測資料", "air": "空氣品質檢測資料", "noise": "噪音監測資料"}
BASIC_SHEET = "監測點基本資料"
ITEM_SHEETS = {"water": "水質檢測項目", "air": "空品檢測項目", "noise": "噪音檢測項目"}
BASIC_HEADER = ["計畫代碼", "書件案號", "書件名稱", "執行現況", "施工日期", "竣工日期", "營運日期", "備註"]
HEADERS = {
    "date_start": "日期(起)", "time_start": "時間(起)", "date_end": "日期(迄)", "time_end": "時間(迄)", "site": "採樣地點", "coord_sys": "座標系統", "x": "採樣座標-經度 X", "y": "採樣座標-緯度 Y",
    "depth": "採樣深度(公尺)", "water_depth": "採樣水深(公尺)", "place_no": "場所編號", "site_height": "採樣地點高度(公尺)", "sampling_height": "污染物採樣高度(公尺)", "ems": "管制編號", "stack_no": "煙道編號",
    "category": "檢測類別", "item_name": "檢測項目", "unit_code": "檢測濃度/質量單位", "unit_other": "其他檢測濃度/質量單位", "compare": "比較關係", "value": "檢測數值", "mdl": "檢測極限", "method_out": "檢測方法",
    "license": "檢測機構許可證號", "agency_other": "其他檢測機構名稱", "ctrl_std": "管制標準", "ctrl_zone": "管制區", "env_std": "環境音量標準", "freq_range": "頻率範圍", "char_type": "音源發聲特性", "period": "監測時段",
}
NOISE_HEADERS = {"site": "監測地點", "period": "監測時段", "value": "監測數值", "unit_code": "監測單位", "unit_other": "其他監測單位", "method_out": "監測方法"}
WIDTHS = {"water": {"A": 12.0, "E": 13.1, "F": 15.1, "G": 23.2, "H": 23.1, "I": 21.1, "K": 13.1, "L": 13.1, "N": 26.8, "O": 32.8, "P": 13.1, "T": 25.4, "U": 25.4}}


def headers(module: str) -> list[str]:
    own = HEADERS | (NOISE_HEADERS if module == "noise" else {})
    return [own[c.key] for c in COLUMNS[module]]


def cells(report: DataFrame, module: str) -> DataFrame:
    """The report's columns in order, each a struct ``t, num, txt``; columns that it lacks are blank."""

    def one(c: ColumnMeta):
        has = lambda n, t: F.col(n).try_cast(t) if n in report.columns else F.lit(None).cast(t)
        if c.type == "a":
            num, txt = has(f"{c.key}_num", "double"), has(f"{c.key}_txt", "string")
        elif c.type == "n":
            num, txt = has(c.key, "double"), F.lit(None).cast("string")
        else:
            num, txt = F.lit(None).cast("double"), has(c.key, "string")
        kind = cell_type(c.type, num, txt)
        return F.struct(kind["t"].alias("t"), kind["v"].cast("double").alias("num"), txt.alias("txt")).alias(c.key)

    return report.select(*[one(c) for c in COLUMNS[module]])


def _rows(report: DataFrame, module: str) -> Iterator[list]:
    whole = lambda v: int(v) if v is not None and v.is_integer() else v
    for row in cells(report, module).toLocalIterator():
        yield [(c.t, c.txt if c.t == "s" else whole(c.num)) for c in row]


def module_workbook(module: str, report: DataFrame | None, basic: list[list] | None = None) -> bytes:
    """A module's workbook; without a report it is the blank template, without ``basic`` the project sheet has its header only."""
    rows = _rows(report, module) if report is not None else []
    sheets = [(BASIC_SHEET, BASIC_HEADER, [[("s", v) for v in r] for r in basic or []]), (ITEM_SHEETS[module], headers(module), rows)]
    return write_workbook(sheets, {ITEM_SHEETS[module]: WIDTHS.get(module, {})})


def workbooks(reports: dict[str, DataFrame], day: str, project: str | None = None, basic: list[list] | None = None, order: tuple[str, ...] = ("sheet_id", "item_idx")) -> dict[str, bytes]:
    """File name and bytes of each module's workbook, rows in ``order`` (the order of import)."""
    return {file_name(LABELS[m], project, day): module_workbook(m, r.orderBy(*order), basic) for m, r in reports.items()}

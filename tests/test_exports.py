"""Workbooks by module, blank templates and edited tables."""

from pyspark.sql import functions as F

from fieldsheet.operators import extract as E
from fieldsheet.operators import master as M
from fieldsheet.sources import exports, workbook


def cells_of(data: bytes, sheet: str) -> dict:
    return {x[3]: x[8] if x[6] == "s" else x[7] for x in workbook.read_workbook("r.xlsx", data) if x[2] == sheet}


def test_workbooks_of_modules(spark):
    water = spark.createDataFrame([(2, 0, "2026-02-05", "10:30", "b", 47, "<", 0.5, None, 4), (1, 0, None, None, 'a "1"\nx', 7, None, None, "無法判讀", None)],
                                  "sheet_id long, item_idx int, date_start string, time_start string, site string, unit_code int, compare string, value_num double, value_txt string, license int")
    noise = spark.createDataFrame([(1, 0, "日間", 55.5)], "sheet_id long, item_idx int, period string, value_num double")
    got = exports.workbooks({"water": water, "noise": noise}, "2026-02-05", "P1", [["P1", None]])
    assert list(got) == ["水質檢測資料_P1_20260205.xlsx", "噪音監測資料_P1_20260205.xlsx"]
    w = cells_of(got["水質檢測資料_P1_20260205.xlsx"], "水質檢測項目")
    assert (w["A1"], w["U1"], w["E2"], w["Q2"], w["A3"], w["N3"], w["Q3"], w["T3"]) == ("日期(起)", "其他檢測機構名稱", 'a "1"\nx', "無法判讀", 46058, 47, 0.5, 4)
    assert abs(w["B3"] - 0.4375) < 1e-12 and "A2" not in {k for k, v in w.items() if v is not None}
    assert cells_of(got["水質檢測資料_P1_20260205.xlsx"], "監測點基本資料")["A2"] == "P1"
    assert cells_of(got["噪音監測資料_P1_20260205.xlsx"], "噪音檢測項目")["E1"] == "監測地點"


def test_blank_templates():
    for m in ("water", "air", "noise"):
        c = cells_of(exports.module_workbook(m, None), exports.ITEM_SHEETS[m])
        assert len(c) == len(exports.headers(m)) and all(k.endswith("1") for k in c)


def test_repeated_keys_of_a_table_do_not_multiply(spark):
    t = spark.createDataFrame([("water", "unitCodes", "mg/L", "9"), ("water", "unitCodes", "mg/L", "3"), ("water", "unitCodes", "ppm", "x")], "module string, name string, k string, v string")
    df = spark.createDataFrame([("mg/L",), ("ppm",), (None,)], "e string")
    got = E.mapped(df, F.col("e"), "code", t, "water", "unitCodes").collect()
    assert sorted((r.e or "", r.code) for r in got) == [("", None), ("mg/L", 3), ("ppm", None)]


def test_override_keeps_other_tables(spark):
    d = M.table_rows(spark)
    t = M.override(d, d.where("module = 'air'").limit(0))
    assert t.count() == d.count()

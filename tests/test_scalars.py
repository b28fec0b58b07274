import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldsheet.functions import scalars as S

C = lambda *x: [F.lit(v) for v in x]
def cases():
    return [
        (S.roc_date(*C("115", "02", "05")), "2026-02-05"), (S.roc_date(*C("115年", " 2月", "5日")), "2026-02-05"), (S.roc_date(*C("115", "13", "40")), "2026-13-40"), (S.roc_date(*C("年", "1", "1")), None),
        (S.hour_minute(*C("10", "43")), "10:43"), (S.hour_minute(*C("08", "30")), "08:30"), (S.hour_minute(*C("x", "30")), None),
        (S.sci(F.lit("6.0×104")), 60000.0), (S.sci(F.lit("3.8×105")), 380000.0), (S.sci(F.lit("6.5×102")), 650.0), (S.sci(F.lit("25.4")), None), (S.sci(F.lit(" 2 X 103")), 2000.0),
        (S.to_number(F.lit("25.4")), 25.4), (S.to_number(F.lit("ND")), None), (S.to_number(F.lit("　.5 ")), 0.5), (S.to_number(F.lit("5d")), None), (S.to_number(F.lit("NaN")), None), (S.to_number(F.lit("")), None), (S.to_number(F.lit("1e3")), 1000.0), (S.to_number(F.lit("１２")), None),
        (S.norm_hm(F.lit("8:43")), "08:43"), (S.norm_hm(F.lit("24:00")), None), (S.norm_hm(F.lit("9：05")), "09:05"), (S.norm_hm(F.lit("9:5")), None),
        (S.round1(F.lit(-0.25)), -0.2), (S.round1(F.lit(0.25)), 0.3), (S.pad2(F.lit(123)), "123"), (S.roc_dot(F.lit("115.01.19(平日)")), "2026-01-19"), (S.roc_dot(F.lit("2026.01.19")), "1937-01-19"),
        (S.niea(F.lit("依 NIEA P201.96C")), "NIEA P201"), (S.license_no(F.lit("第000號")), 0), (S.license_no(F.lit("檢字第036號")), 36), (S.license_no(F.lit("036")), None), (S.zone(F.lit("第三類")), "第3類"), (S.zone(F.lit("第五類")), None),
        (S.date_serial(F.lit("2026-02-05")), 46058), (S.date_serial(F.lit("2026-13-40")), None), (S.time_serial(F.lit("12:00")), 0.5), (S.record_key(*C("water", "", "d")), None), (S.record_key(*C("water", "s", "d")), "water|s|d"),
        (S.end_time(F.lit(0)), "23:59"), (S.end_time(F.lit(8)), "07:59"), (S.mdl_text(F.lit(" ─")), None), (S.mdl_text(F.lit("0.1")), "0.1"), (S.method_code(*C("x", "NIEA W455.52C"), F.lit(None)), "NIEA W455"), (S.method_code(*C("x", "see NIEA W1"), F.lit(None)), "see NIEA W1"),
        (S.number_text(F.lit(3.0)), "3"), (S.number_text(F.lit(3.5)), "3.5"), (F.array_join(S.alias_list(F.lit("a， b,,c ，")), "|"), "a|b|c"),
    ]


def test_vectors(spark):
    table = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(table)]).first()
    for i, (_, want) in enumerate(table):
        assert row[i] == pytest.approx(want) if isinstance(want, float) else row[i] == want, (i, row[i], want)


def test_censoring(spark):
    water = {"ND": ("ND", None, "ND"), " nd": ("ND", None, "ND"), "NA": ("未檢測", None, "未檢測"), "<0.05": ("<", 0.05, None), "< 0.05": ("<", 0.05, None), "<": ("<", None, ""), "6.0×104": (None, 60000.0, None), "無法": (None, None, "無法"), None: (None, None, None)}
    df = spark.createDataFrame([(k,) for k in water], "t string")
    got = {r[0]: tuple(r[1:]) for r in df.select("t", *S.censor_water(F.lit(None).cast("double"), F.col("t")).values()).collect()}
    assert got == water
    air = {"ND": (None, None, "ND", False, True), "NA": (None, None, "NA", False, False), "--": (None, None, None, True, False), "< 2": ("<", 2.0, None, False, False), "6.0×104": (None, None, "6.0×104", False, False), None: (None, None, None, True, None)}
    df = spark.createDataFrame([(k,) for k in air], "t string")
    got = {r[0]: tuple(r[1:]) for r in df.select("t", *S.censor_air(F.lit(None).cast("double"), F.col("t")).values()).collect()}
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in air.items()}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20000))
def test_column_names(n):
    name, back = S.column_name(n), 0
    for c in name:
        back = back * 26 + ord(c) - 64
    assert back == n

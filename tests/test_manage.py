"""Edits of master data: order, errors, empty tables, nulls and ties."""

from pyspark.sql import functions as F

from fieldsheet.operators import manage as G

STATIONS = "name string, project_code string, coord_sys int, x double, y double, last_end_time string, aliases array<string>"
FORMS = "seq long, original string, name string, project_code string, coord_sys string, x string, y string, last_end_time string, aliases string"


def forms(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], FORMS)


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_stations_renames_and_deletions(spark):
    old = spark.createDataFrame([("A", None, None, 1.0, 2.0, None, []), ("B", None, None, None, None, None, [])], STATIONS)
    f = G.station_forms(forms(spark, (1, "A", " A2 "), (2, "B", " "), (3, None, "C", "", "2", "x"), (4, None, "D", "", "2", " 1.5 ", None, "7:05", "p, q")))
    assert [r["error"] for r in f.orderBy("seq").collect()] == [None, "name", "coordinates", None]
    gone = spark.createDataFrame([(5, "B"), (6, "nobody"), (7, None)], "seq long, gone string")
    got = G.save(old, f, "name", gone)
    assert names(got) == ["A2", "D"]
    d = got.where("name = 'D'").first()
    assert (d["project_code"], d["coord_sys"], d["x"], d["last_end_time"], d["aliases"]) == (None, 2, 1.5, "07:05", ["p", "q"])
    # A name that was given up can be taken again, and the last word counts whatever the order of rows is.
    again = G.station_forms(forms(spark, (9, "A2", "A"), (8, "A", "A2")))
    assert names(G.save(old, again, "name")) == ["A", "B"]
    assert names(G.save(old.limit(0), f.limit(0), "name")) == []
    assert names(G.save(old, f.limit(0), "name")) == ["A", "B"]


def test_projects_check_dates_and_rows(spark):
    f = spark.createDataFrame([(1, None, "P", "[[1,2,3,4,5,6,7,8]]", "2026-01-31"), (2, None, "Q", "[1]", None), (3, None, "R", "[null]", None), (4, None, "S", "", "2026/1/1"), (5, None, None, None, None), (6, None, "T", "x", "")],
                              "seq long, original string, code string, basic_rows string, construction_date string")
    f = f.withColumns({c: F.lit(None).cast("string") for c in G.PROJECT if c not in f.columns})
    assert [r["error"] for r in G.project_forms(f).orderBy("seq").collect()] == [None, "rows", "rows", "date", "code", "rows"]


def test_active_project(spark):
    rows = [("a", 1, "save", "P"), ("a", 2, "save", "Q"), ("b", 1, "use", "P"), ("b", 2, "delete", "P"), ("c", 2, "delete", "P"), ("c", 1, "use", "Q"), ("d", 1, "delete", "P"), ("d", 2, "save", "R")]
    got = G.active_project(spark.createDataFrame(rows, "store string, seq long, kind string, code string"))
    assert {r["store"]: r["active"] for r in got.collect()} == {"a": "P", "b": None, "c": "Q", "d": "R"}


def test_table_rows(spark):
    rows = [("n", 1, True, "", "5"), ("n", 2, True, " k ", "1"), ("n", 3, True, "k", "2"), ("n", 4, True, None, " "), ("bad", 1, True, "k", "x"), ("bad", 2, True, "j", "1"), ("t", 1, False, "k", "v"), ("u", 1, False, "k", None)]
    got = G.table_rows(spark.createDataFrame(rows, "name string, seq long, numeric boolean, k string, v string"))
    assert sorted(map(tuple, got.collect()), key=repr) == [("n", "", 5.0, None), ("n", "k", 2.0, None), ("t", "k", None, "v")]


def test_reset_reopen_and_order(spark):
    stored = spark.createDataFrame([("a", "data", "k", "v", 1), ("b", "data", "k", "v", 1)], "name string, part string, k string, v string, base_version int")
    assert names(G.reset_tables(stored, spark.createDataFrame([("a",), ("a",)], "name string"))) == ["b"]
    r = spark.createDataFrame([(1, "u", "w", ""), (2, "v", "w", "P")], "import_id int, uid string, warnings string, project_code string")
    assert [x.asDict() for x in G.reopen(r, 1, "Z").collect()] == [{"import_id": 1, "uid": "u", "project_code": "Z"}]
    rows = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None)], "sheet_id int, item_idx int")
    sheets = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0)], "sheet_id int, file_ord int, sheet_ord int")
    assert [(x["sheet_id"], x["item_idx"]) for x in G.in_import_order(rows, sheets).collect()] == [(3, None), (2, 0), (2, 1), (1, 0)]

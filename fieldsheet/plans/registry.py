"""Every query by name, and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S
from ..operators import cells as C
from ..operators import compare as D
from ..operators import extract as E
from ..operators import manage as G
from ..operators import master as M
from ..operators import report as R
from ..operators import warnings as N
from ..operators import workspace as K
from . import oracle as O
from .fixtures import duck, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def water(s, d):
    return frame(s, d, "water", "cells")


def water_top(s, d):
    """The cells above the items: what a reader gives that is asked for rows 1 to 14 only."""
    return frame(s, d, "water", "hcells")


def water_body(s, d):
    return frame(s, d, "water", "icells")


def air(s, d):
    return frame(s, d, "air", "cells")


def noise(s, d):
    return frame(s, d, "noise", "cells")


def stations(s, d):
    return frame(s, d, "stations", "st").withColumn("aliases", F.array("alias1", "alias2")).drop("alias1", "alias2")


def water_records(s, d):
    """Water records with their station, as the flagship uses them."""
    none = lambda t: F.lit(None).cast(t)
    h = E.water_heads(water_top(s, d)).withColumns({"coord_sys": none("int"), "x": none("double"), "y": none("double"), "time_end": none("string")})
    return M.match_station(h, stations(s, d))


WATER_REC = f"""{duck('water', 'stations')},
{O.WATER_HEAD},
{O.WATER_ITEMS},
{O.STATION},
rec AS (SELECT wh.*, coalesce(sm.name, station_raw) AS site, sm.name IS NOT NULL AS known, sm.coord_sys, sm.x, sm.y, sm.last_end_time FROM wh LEFT JOIN sm ON station_raw = sm.match_name)
"""


def simple(name: str, make, columns: str, sql: Callable[[str], str], cte: str) -> None:
    """A query that is some columns of an extracted table."""
    names = [c.strip() for c in columns.split(",")]
    query(name, sql(f"SELECT {columns} FROM {cte}"))(lambda s, d: make(s, d).select(*names))


W_ITEMS, A_ITEMS = (lambda s, d: E.water_items(water_body(s, d))), (lambda s, d: E.air_items(air(s, d)))
W_HEADS, A_HEADS, N_HEADS = (lambda s, d: E.water_heads(water_top(s, d))), (lambda s, d: E.air_heads(air(s, d))), (lambda s, d: E.noise_heads(noise(s, d)))
for args in (
    ("prj_water_header", W_HEADS, "sheet_id, station_raw, category, date_start, time_start, date_end, license", O.water, "wh"),
    ("jn_sample_type", W_HEADS, "sheet_id, category, category_mapped", O.water, "wh"),
    ("fn_roc_date", W_HEADS, "sheet_id, date_start", O.water, "wh"), ("fn_hm", W_HEADS, "sheet_id, time_start", O.water, "wh"), ("fn_license", W_HEADS, "sheet_id, license", O.water, "wh"),
    ("prj_water_items", W_ITEMS, "sheet_id, item_idx, row_no, item_name, unit_code, compare, value_num, value_txt, mdl_num, mdl_txt, method_out", O.water, "wit"),
    ("win_contiguous_prefix", W_ITEMS, "sheet_id, item_idx, row_no, raw_name", O.water, "wit"), ("jn_unit_code", W_ITEMS, "sheet_id, item_idx, unit_raw, unit_code", O.water, "wit"),
    ("jn_item_name", W_ITEMS, "sheet_id, item_idx, raw_name, item_name", O.water, "wit"), ("jn_method_override", W_ITEMS, "sheet_id, item_idx, raw_name, raw_method, method_out", O.water, "wit"),
    ("fn_censor_water", W_ITEMS, "sheet_id, item_idx, compare, value_num, value_txt", O.water, "wit"), ("fn_mdl", W_ITEMS, "sheet_id, item_idx, mdl_num, mdl_txt", O.water, "wit"),
    ("prj_air_header", A_HEADS, "sheet_id, station_raw, category, date_start, time_start, date_end, time_end, license", O.air, "ah"), ("fn_end_time", A_HEADS, "sheet_id, time_start, time_end", O.air, "ah"),
    ("prj_air_items", A_ITEMS, "sheet_id, item_idx, item_name, unit_code, compare, value_num, value_txt, mdl_num, method_out, missing", O.air, "ait"), ("jn_air_lookup", A_ITEMS, "sheet_id, item_idx, item_name, unit_code, method_out", O.air, "ait"),
    ("fn_censor_air", A_ITEMS, "sheet_id, item_idx, compare, value_num, value_txt, missing", O.air, "ait"),
    ("prj_noise_header", N_HEADS, "sheet_id, station_raw, category, date_start, time_start, date_end, time_end, coord_sys, x, y, ctrl_std, ctrl_zone, env_std, freq_range, license", O.noise, "nh"),
    ("fn_roc_dot", N_HEADS, "sheet_id, date_start", O.noise, "nh"), ("fn_zone", N_HEADS, "sheet_id, ctrl_zone", O.noise, "nh"), ("fn_env_std", N_HEADS, "sheet_id, category, env_std", O.noise, "nh"),
    ("prj_noise_items", lambda s, d: E.noise_items(noise(s, d)), "sheet_id, item_idx, char_type, period, value_num, unit_code, method_out", O.noise, "nit"),
    ("fn_niea", lambda s, d: E.noise_items(noise(s, d)), "sheet_id, item_idx, method_out", O.noise, "nit"), ("fn_round1", lambda s, d: E.noise_items(noise(s, d)), "sheet_id, item_idx, value_num", O.noise, "nit"),
    ("prj_vib_items", lambda s, d: E.vib_items(noise(s, d)), "sheet_id, item_idx, char_type, period, value_num, unit_code, method_out", O.noise, "vit"),
    ("prj_first_method", lambda s, d: E.vib_items(noise(s, d)).select("sheet_id", "method_out").distinct(), "sheet_id, method_out", O.noise, "(SELECT DISTINCT sheet_id, method_out FROM vit)"),
):
    simple(*args)

_MOD = "CASE WHEN contains(A3, '水質檢測報告') THEN 'water' WHEN contains(A2, '空氣品質檢測報告') OR contains(S2, '空氣品質檢測報告') THEN 'air' WHEN contains(C41, 'L日') OR contains(A3, '環境振動測定報告') THEN 'noise' END"
_ROUTE = ",\n" + O.pivot(("A2", "A3", "S2", "C41"), "rh") + f", rt AS (SELECT sheet_id, {_MOD} AS module FROM rh) "
_OWN = {"water": 0, "air": 1, "noise": 2}
#: Sheets of all modules in one table; some noise sheets carry a title of water, which comes first.
_MIXED = "WITH cells AS (" + " UNION ALL ".join(f"SELECT sheet_id * 10 + {i} AS sheet_id, addr, num, txt FROM ({duck(m)} SELECT * FROM cells)" for m, i in _OWN.items())
_MIXED += f" UNION ALL SELECT sheet_id * 10 + 2, 'A3', NULL, '水質檢測報告' FROM ({duck('noise')} SELECT * FROM cells) WHERE addr = 'C41' AND sheet_id % 4 = 0)" + _ROUTE


def mixed(s, d, titles: bool = True):
    """Cells of all modules, each with the numbers of its own sheets."""
    parts = [f(s, d).select((F.col("sheet_id") * 10 + i).alias("sheet_id"), "addr", "col", "row_no", "num", "txt") for f, i in ((water, 0), (air, 1), (noise, 2))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    title = noise(s, d).where("addr = 'C41' AND sheet_id % 4 = 0").select((F.col("sheet_id") * 10 + 2).alias("sheet_id"), F.lit("A3").alias("addr"), F.lit("A").alias("col"), F.lit(3).alias("row_no"), F.lit(None).cast("double").alias("num"), F.lit("水質檢測報告").alias("txt"))
    return out.unionByName(title) if titles else out


@query("flt_detect_route", _MIXED + "SELECT sheet_id, module FROM rt")
def flt_detect_route(s, d):
    return C.route(mixed(s, d)).select("sheet_id", "module")


@query("flt_unrouted_warn", _MIXED + "SELECT sheet_id, 'sheet ' || sheet_id || ': no module recognises it' AS message FROM rt WHERE module IS NULL")
def flt_unrouted_warn(s, d):
    r = C.route(mixed(s, d)).where("module IS NULL")
    return r.select("sheet_id", F.concat(F.lit("sheet "), F.col("sheet_id").cast("string"), F.lit(": no module recognises it")).alias("message"))


@query("flt_single_module", _MIXED + "SELECT sheet_id, coalesce(contains(C41, 'L日') OR contains(A3, '環境振動測定報告'), FALSE) AS accepted FROM rh")
def flt_single_module(s, d):
    return C.route(mixed(s, d), ("noise",)).select("sheet_id", F.col("module").isNotNull().alias("accepted"))


@query("src_admit_files", "WITH f AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN '.XLS' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.xlsm' WHEN 3 THEN '.csv' ELSE '.xlsx.pdf' END AS file FROM part) SELECT p_partkey, file, regexp_matches(lower(file), '\\.(xls|xlsx|xlsm)$') AS accepted FROM f")
def src_admit_files(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    ext = F.element_at(F.array(*map(F.lit, (".XLS", ".xlsx", ".xlsm", ".csv", ".xlsx.pdf"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", F.concat("p_name", ext).alias("file")).withColumn("accepted", F.col("file").rlike(r"(?i)\.(xls|xlsx|xlsm)$"))


_DEFAULTS = "(VALUES " + ", ".join(f"('{m}', '{n}', '{k}', '{v}')" for (m, n), t in L.DEFAULT_TABLES.items() for k, v in t.items()) + ") AS t(module, name, k, v)"
_STORED = "SELECT 'water' AS module, 'unitCodes' AS name, n_name AS k, CAST(n_nationkey AS VARCHAR) AS v FROM nation"


@query("src_table_override", f"SELECT * FROM {_DEFAULTS} WHERE NOT (module = 'water' AND name = 'unitCodes') UNION ALL {_STORED}")
def src_table_override(s, d):
    stored = s.read.parquet(f"{d}/nation.parquet").select(F.lit("water").alias("module"), F.lit("unitCodes").alias("name"), F.col("n_name").alias("k"), F.col("n_nationkey").cast("string").alias("v"))
    return M.override(M.table_rows(s), stored)


@query("flt_station_scope", duck("stations") + " SELECT ord, name, project_code FROM st WHERE project_code IS NULL OR project_code = '' OR project_code = 'P5'")
def flt_station_scope(s, d):
    return stations(s, d).where(M.in_scope(F.col("project_code"), "P5")).select("ord", "name", "project_code")


@query("flt_history_scope", duck("imports") + " SELECT uid, import_id, project_code FROM im WHERE nullif(project_code, '') IS NOT DISTINCT FROM nullif('', '')")
def flt_history_scope(s, d):
    return frame(s, d, "imports", "im").where(M.same_project(F.col("project_code"), None)).select("uid", "import_id", "project_code")


_CODES = "(VALUES " + ", ".join(f"('{t}', '{k}', '{v}')" for t, x in (("unit", L.UNIT_CODES), ("agency", L.AGENCY_CODES)) for k, v in x.items()) + ") AS c(kind, code, label)"


@query("flt_code_search", f"SELECT kind, code, label FROM {_CODES} WHERE contains(lower(code || ' ' || label), lower(trim(' MG/l ')))")
def flt_code_search(s, d, search: str = " MG/l "):
    rows = [(t, k, v) for t, x in (("unit", L.UNIT_CODES), ("agency", L.AGENCY_CODES)) for k, v in x.items()]
    c = s.createDataFrame(rows, "kind string, code string, label string")
    return c.where(F.lower(F.concat_ws(" ", "code", "label")).contains(F.lower(S.trim(F.lit(search)))))


@query("flt_outdated_tables", "SELECT n_name AS name, CAST(n_nationkey % 4 AS INTEGER) AS base_version FROM nation WHERE coalesce(CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 4 END, 0) < 2 AND n_regionkey <> 1")
def flt_outdated_tables(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").withColumn("base_version", (F.col("n_nationkey") % 4).cast("int"))
    return n.where((F.coalesce("base_version", F.lit(0)) < L.TABLE_VERSIONS["water"]) & (F.col("n_regionkey") != 1)).select(F.col("n_name").alias("name"), "base_version")


@query("jn_station_memory", WATER_REC + "SELECT sheet_id, station_raw, site, known, coord_sys, x, y, last_end_time FROM rec")
def jn_station_memory(s, d):
    return water_records(s, d).select("sheet_id", "station_raw", "site", "known", "coord_sys", "x", "y", "last_end_time")


@query("jn_fill_coords", duck("noise", "stations") + f",\n{O.NOISE},\n" + "sp AS (SELECT s_suppkey AS ord, s_name AS name, 2 AS coord_sys, s_acctbal AS x, s_acctbal AS y FROM supplier) SELECT nh.sheet_id, coalesce(nh.coord_sys, sp.coord_sys) AS coord_sys, coalesce(nh.x, sp.x) AS x, coalesce(nh.y, sp.y) AS y, CASE WHEN nh.y IS NULL AND sp.y IS NOT NULL THEN 'memory' END AS y_via FROM nh LEFT JOIN sp ON station_raw = name")
def jn_fill_coords(s, d):
    sp = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.lit(2).alias("coord_sys"), F.col("s_acctbal").alias("x"), F.col("s_acctbal").alias("y"), F.lit(None).cast("string").alias("last_end_time"), F.lit(None).cast("array<string>").alias("aliases"))
    return M.match_station(E.noise_heads(noise(s, d)), sp).select("sheet_id", "coord_sys", "x", "y", "y_via")


# Two suppliers are one site: each name is an alias of it.
_SITE = "sp AS (SELECT s_name AS alias, 'SITE-' || (s_suppkey // 2) AS name FROM supplier), ns AS (SELECT nh.*, coalesce(name, station_raw) AS site FROM nh LEFT JOIN sp ON station_raw = alias), vs AS (SELECT vh.*, coalesce(name, station_raw) AS site FROM vh LEFT JOIN sp ON station_raw = alias)"


def sites(s, d):
    none = lambda t: F.lit(None).cast(t)
    p = s.read.parquet(f"{d}/supplier.parquet").withColumn("name", F.concat(F.lit("SITE-"), F.floor(F.col("s_suppkey") / 2).cast("string")))
    return p.groupBy("name").agg(F.min("s_suppkey").alias("ord"), F.sort_array(F.collect_set("s_name")).alias("aliases")).select(
        "ord", "name", "aliases", none("int").alias("coord_sys"), none("double").alias("x"), none("double").alias("y"), none("string").alias("last_end_time"))


@query("jn_vib_mate", O.noise("").rstrip() + f",\n{_SITE}, m AS (SELECT site, date_start, min(sheet_id) AS mate FROM ns GROUP BY ALL) SELECT vs.sheet_id, vs.station_raw, vs.site, vs.date_start, ns.coord_sys, ns.x, ns.y, ns.license, m.mate IS NOT NULL AS has_mate FROM vs LEFT JOIN m ON m.site = vs.site AND m.date_start IS NOT DISTINCT FROM vs.date_start LEFT JOIN ns ON ns.sheet_id = m.mate")
def jn_vib_mate(s, d):
    c, st = noise(s, d), sites(s, d)
    v = E.vib_mates(M.match_station(E.noise_heads(c), st), M.match_station(E.vib_heads(c), st))
    return v.select("sheet_id", "station_raw", "site", "date_start", "coord_sys", "x", "y", "license", "has_mate")


@query("win_first_match", duck("stations") + f",{O.STATION} SELECT match_name, name FROM sm")
def win_first_match(s, d):
    return M.station_names(stations(s, d)).select("match_name", "name")


# Missing fields and report rows of water.
_REQ = {lv: [c.key for c in R.COLUMNS["water"] if c.required and c.level == lv] for lv in ("station", "item")}
_VAL = lambda k: "coalesce(CAST(value_num AS VARCHAR), value_txt)" if k == "value" else f"CAST({k} AS VARCHAR)"
_MISS = WATER_REC + ", mi AS (" + " UNION ALL ".join(
    [f"SELECT sheet_id, CAST(NULL AS INTEGER) AS item_idx, '{k}' AS key FROM rec2 WHERE coalesce({O.tr(_VAL(k))}, '') = ''" for k in _REQ["station"]] + [f"SELECT sheet_id, item_idx, '{k}' FROM wit WHERE coalesce({O.tr(_VAL(k))}, '') = ''" for k in _REQ["item"]]) + ") "
_MISS = _MISS.replace(", mi AS", ", rec2 AS (SELECT *, CAST(NULL AS VARCHAR) AS time_end FROM rec), mi AS", 1)


def water_missing(s, d):
    return R.missing(water_records(s, d), E.water_items(water_body(s, d)), "water")


query("val_required", _MISS + "SELECT * FROM mi")(water_missing)


@query("agg_missing_by_module", _MISS + "SELECT 'water' AS module, key, count(*) AS n FROM mi GROUP BY key")
def agg_missing_by_module(s, d):
    return water_missing(s, d).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("water").alias("module"), "key", "n")


@query("jn_missing_meta", _MISS + "SELECT key, CASE WHEN item_idx IS NULL THEN 'station' ELSE 'item' END AS level, count(*) AS n FROM mi GROUP BY ALL")
def jn_missing_meta(s, d):
    meta = s.createDataFrame([(c.key, c.level) for c in R.COLUMNS["water"]], "key string, level string")
    return water_missing(s, d).join(meta, "key").groupBy("key", "level").agg(F.count("*").alias("n"))


_W = {
    "category": "NOT category_mapped", "time": "date_start IS NULL", "license": "license IS NULL", "station": "NOT known AND (coord_sys IS NULL OR x IS NULL OR y IS NULL)",
}


@query("val_warnings", WATER_REC + " UNION ALL ".join([f"SELECT sheet_id, '{k}' AS warning, CAST(1 AS BIGINT) AS n FROM rec WHERE {v}" for k, v in _W.items()] + ["SELECT sheet_id, 'unit', count(*) FROM wit WHERE unit_code IS NULL GROUP BY sheet_id", "SELECT sheet_id, 'items', 1 FROM rec WHERE sheet_id NOT IN (SELECT sheet_id FROM wit)"]))
def val_warnings(s, d):
    return N.water(water_records(s, d), E.water_items(water_body(s, d)))


# Air, noise and vibration: stations, mates, missing fields and warnings. Half the stations, and three of four sites, are known.
def _station_rows(df, name):
    return df.select(F.col("ord"), name.alias("name"), F.array(name).alias("aliases"), "coord_sys", "x", "y", F.lit(None).cast("string").alias("last_end_time"))


def air_records(s, d):
    none = lambda t: F.lit(None).cast(t)
    c = s.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 6 > 0, 2).alias("coord_sys"), F.col("c_acctbal").alias("x"), F.col("c_acctbal").alias("y"))
    h = A_HEADS(s, d).withColumns({"coord_sys": none("int"), "x": none("double"), "y": none("double")})
    return M.match_station(h, _station_rows(c, F.concat(F.lit("站"), F.col("ord").cast("string"))))


def noise_records(s, d):
    """Noise records, vibration records, and these with their mates."""
    c, st = noise(s, d), sites(s, d).where("(ord DIV 2) % 4 <> 2")
    n, v = M.match_station(E.noise_heads(c), st), M.match_station(E.vib_heads(c), st)
    return n, v, E.vib_mates(n, v)


_AIR_REC = O.air("").rstrip() + ", rec AS (SELECT ah.*, station_raw AS site, c_custkey IS NOT NULL AS known, CASE WHEN c_custkey % 6 > 0 THEN 2 END AS coord_sys, c_acctbal AS x, c_acctbal AS y FROM ah LEFT JOIN customer ON c_custkey % 2 = 0 AND station_raw = '站' || c_custkey)"
_SITE_KNOWN = _SITE.replace("FROM supplier)", "FROM supplier WHERE (s_suppkey // 2) % 4 <> 2)").replace("AS site FROM", "AS site, name IS NOT NULL AS known FROM")
_REC_COLUMNS = "sheet_id, site, known, category, date_start, time_start, date_end, time_end, ctrl_std, ctrl_zone"
_NOISE_REC = O.noise("").rstrip() + f",\n{_SITE_KNOWN}, m AS (SELECT site, date_start, min(sheet_id) AS mate FROM ns GROUP BY ALL), vm AS (SELECT vs.*, m.mate, ns.coord_sys, ns.x, ns.y, ns.license FROM vs LEFT JOIN m ON m.site = vs.site AND m.date_start IS NOT DISTINCT FROM vs.date_start LEFT JOIN ns ON ns.sheet_id = m.mate)"
_NOISE_REC += f", rec AS (SELECT {_REC_COLUMNS}, coord_sys, x, y, license FROM ns UNION ALL SELECT {_REC_COLUMNS}, coord_sys, x, y, license FROM vm), it AS (SELECT * FROM nit UNION ALL SELECT * FROM vit)"


def _missing_sql(module: str, head: str, items: str) -> str:
    keys = {lv: [c.key for c in R.COLUMNS[module] if c.required and c.level == lv] for lv in ("station", "item")}
    value = _VAL if module == "air" else lambda k: "CAST(value_num AS VARCHAR)" if k == "value" else _VAL(k)
    blank = lambda k: f"coalesce({O.tr(value(k))}, '') = ''"
    parts = [f"SELECT sheet_id, CAST(NULL AS INTEGER) AS item_idx, '{k}' AS key FROM rec WHERE {blank(k)}" for k in keys["station"]] + [f"SELECT sheet_id, item_idx, '{k}' FROM {items} WHERE {blank(k)}" for k in keys["item"]]
    return head + " " + " UNION ALL ".join(parts)


@query("val_required_air", _missing_sql("air", _AIR_REC, "ait"))
def val_required_air(s, d):
    return R.missing(air_records(s, d), E.air_items(air(s, d)), "air")


@query("val_required_noise", _missing_sql("noise", _NOISE_REC, "it"))
def val_required_noise(s, d):
    c, (n, _, v) = noise(s, d), noise_records(s, d)
    return R.missing(n.unionByName(v, allowMissingColumns=True), E.noise_items(c).unionByName(E.vib_items(c)), "noise")


def _warning_sql(kinds: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT sheet_id, '{k}' AS warning, count(*) AS n FROM {t} WHERE {w} GROUP BY sheet_id" for t, k, w in kinds)


_NO_PLACE = "NOT known AND (coord_sys IS NULL OR x IS NULL OR y IS NULL)"


@query("val_warnings_air", _AIR_REC + ", sf AS (SELECT sheet_id FROM a1 WHERE NOT contains(M6, '監測地點')) " + _warning_sql([
    ("sf", "site", "TRUE"), ("rec", "license", "license IS NULL"), ("rec", "time", "date_start IS NULL"), ("rec", "midnight", "time_start = '00:00'"), ("rec", "station", _NO_PLACE),
    ("ait", "value", "missing"), ("ait", "unit", "unit_code IS NULL"), ("ait", "method", "method_out IS NULL")]))
def val_warnings_air(s, d):
    return N.air(air_records(s, d), E.air_items(air(s, d)))


@query("val_warnings_noise", _NOISE_REC + " " + _warning_sql([
    ("ns", "site", "station_raw = ''"), ("ns", "category", "category IS NULL"), ("ns", "time", "date_start IS NULL"), ("ns", "license", "license IS NULL"), ("ns", "x", "x IS NULL"), ("ns", "y", "y IS NULL"), ("ns", "zone", "ctrl_zone IS NULL"),
    ("ns", "road", "category = '道路交通噪音' AND env_std = 0"), ("ns", "station", _NO_PLACE), ("vs", "site", "station_raw = ''"), ("vs", "time", "date_start IS NULL"), ("vs", "station", "NOT known"), ("vm", "mate", "mate IS NULL"),
    ("it", "value", "value_num IS NULL"), ("it", "method", "item_idx = 0 AND method_out IS NULL")]))
def val_warnings_noise(s, d):
    c, (n, v, mated) = noise(s, d), noise_records(s, d)
    return N.noise(n, E.noise_items(c)).unionByName(N.vibration(v, mated, E.vib_items(c)))


# Extraction with edited tables: the stored tables replace the defaults.
_EDITED = {("water", "unitCodes"): {"mg/L": 7, "ppm": 9}, ("water", "itemNameMap"): {"溶氧": "DO"}, ("water", "methodOverrides"): {"溶氧": "NIEA X1", "項目2": "NIEA X2"}, ("water", "sampleTypeMap"): {"溫泉水": "溫泉"},
           ("air", "unitMap"): {"SO2": 1, "NO2": 2}, ("air", "methodMap"): {"NO2": "NIEA X3"}, ("noise", "constMap"): {"管制標準": "另訂"}}


def edited(s):
    return M.override(M.table_rows(s), M.table_rows(s, _EDITED))


def _with_edited(sql: str) -> str:
    for key, name in ((("water", "unitCodes"), "e"), (("water", "itemNameMap"), "name"), (("water", "methodOverrides"), "name"), (("water", "sampleTypeMap"), "B11"), (("air", "unitMap"), "name"), (("air", "methodMap"), "name")):
        sql = sql.replace(O.case(L.DEFAULT_TABLES[key], name), O.case(_EDITED[key], name))
    return sql.replace(f"'{L.NOISE_CONSTANTS['管制標準']}' AS ctrl_std", "'另訂' AS ctrl_std").replace(f"'{L.NOISE_CONSTANTS['頻率範圍(噪音)']}' AS freq_range", "CAST(NULL AS VARCHAR) AS freq_range")


@query("jn_tables_water", _with_edited(O.water("SELECT sheet_id, category, category_mapped, item_idx, item_name, unit_code, method_out FROM wh JOIN wit USING (sheet_id)")))
def jn_tables_water(s, d):
    t = edited(s)
    return R.flatten(E.water_heads(water_top(s, d), t), E.water_items(water_body(s, d), t)).select("sheet_id", "category", "category_mapped", "item_idx", "item_name", "unit_code", "method_out")


@query("jn_tables_air", _with_edited(O.air("SELECT sheet_id, item_idx, item_name, unit_code, method_out FROM ait")))
def jn_tables_air(s, d):
    return E.air_items(air(s, d), edited(s)).select("sheet_id", "item_idx", "item_name", "unit_code", "method_out")


@query("jn_tables_noise", _with_edited(O.noise("SELECT sheet_id, ctrl_std, freq_range FROM nh UNION ALL SELECT sheet_id, ctrl_std, freq_range FROM vh")))
def jn_tables_noise(s, d):
    c, t, names = noise(s, d), edited(s), ("sheet_id", "ctrl_std", "freq_range")
    return E.noise_heads(c, t).select(*names).unionByName(E.vib_heads(c, t).select(*names))


_FLAT = "SELECT sheet_id, item_idx, date_start, time_start, site, category, license, item_name, unit_code, compare, value_num, value_txt, mdl_num, mdl_txt, method_out, coord_sys, x, y FROM rec JOIN wit USING (sheet_id)"


@query("prj_flatten_report", WATER_REC + _FLAT)
def prj_flatten_report(s, d):
    """The flagship: cells to report rows."""
    return R.flatten(water_records(s, d), E.water_items(water_body(s, d))).select("sheet_id", "item_idx", "date_start", "time_start", "site", "category", "license", "item_name", "unit_code", "compare", "value_num", "value_txt", "mdl_num", "mdl_txt", "method_out", "coord_sys", "x", "y")


@query("prj_cell_type", O.water("SELECT sheet_id, CASE WHEN date_start IS NULL THEN 's' ELSE 'd' END AS date_t, CAST(date_diff('day', DATE '1899-12-30', TRY_CAST(date_start AS DATE)) AS DOUBLE) AS date_v, CASE WHEN time_start IS NULL THEN 's' ELSE 'tm' END AS time_t, (CAST(split_part(time_start, ':', 1) AS INTEGER) * 60 + CAST(split_part(time_start, ':', 2) AS INTEGER)) / 1440 AS time_v FROM wh"))
def prj_cell_type(s, d):
    none = F.lit(None).cast("double")
    a, b = R.cell_type("d", none, F.col("date_start")), R.cell_type("t", none, F.col("time_start"))
    return W_HEADS(s, d).select("sheet_id", a["t"].alias("date_t"), a["v"].alias("date_v"), b["t"].alias("time_t"), b["v"].alias("time_v"))


@query("fn_date_serial", O.water("SELECT sheet_id, date_diff('day', DATE '1899-12-30', TRY_CAST(date_start AS DATE)) AS serial FROM wh"))
def fn_date_serial(s, d):
    return W_HEADS(s, d).select("sheet_id", S.date_serial(F.col("date_start")).alias("serial"))


@query("fn_time_serial", O.air("SELECT sheet_id, (CAST(split_part(time_end, ':', 1) AS INTEGER) * 60 + CAST(split_part(time_end, ':', 2) AS INTEGER)) / 1440 AS serial FROM ah"))
def fn_time_serial(s, d):
    return A_HEADS(s, d).select("sheet_id", S.time_serial(F.col("time_end")).alias("serial"))


_PROJ = "p AS (SELECT n_name AS code, CAST(n_nationkey AS VARCHAR) AS doc_no, n_name || ' 案' AS doc_name, '施工中' AS status, n_regionkey FROM nation)"


@query("prj_basic_rows", f"WITH {_PROJ} SELECT code AS project, 0 AS row_idx, code, doc_no, doc_name, status FROM p WHERE n_regionkey > 1 UNION ALL SELECT code, i, code || '-' || i, doc_no, CAST(NULL AS VARCHAR), status FROM p, (VALUES (0), (1)) t(i) WHERE n_regionkey <= 1")
def prj_basic_rows(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    none = F.lit(None).cast("string")
    row = lambda i: F.array(F.concat("n_name", F.lit(f"-{i}")), F.col("n_nationkey").cast("string"), none, F.lit("施工中"), none, none, none, none)
    p = n.select(F.col("n_name").alias("code"), F.col("n_nationkey").cast("string").alias("doc_no"), F.concat("n_name", F.lit(" 案")).alias("doc_name"), F.lit("施工中").alias("status"),
                 *[none.alias(c) for c in ("construction_date", "completion_date", "operation_date", "note")], F.when(F.col("n_regionkey") <= 1, F.array(row(0), row(1))).alias("basic_rows"))
    return R.basic_rows(p, "air").select("project", "row_idx", "code", "doc_no", "doc_name", "status")


@query("agg_row_count", WATER_REC + ", c AS (SELECT sheet_id, count(*) AS n FROM wit GROUP BY sheet_id) SELECT site, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_records FROM rec JOIN c USING (sheet_id) GROUP BY site")
def agg_row_count(s, d):
    i = E.water_items(water_body(s, d)).groupBy("sheet_id").agg(F.count("*").alias("n"))
    return water_records(s, d).join(i, "sheet_id").groupBy("site").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_records"))


# Imports: duplicates and history. The last year's records are new, the one before the workspace, the rest history.
_KEYED = duck("imports") + ", k AS (SELECT *, CASE WHEN site <> '' AND day <> '' THEN module || '|' || site || '|' || day END AS key, CASE WHEN import_id < 200000 THEN 'history' WHEN import_id < 200100 THEN 'workspace' ELSE 'new' END AS part FROM im), ws AS (SELECT DISTINCT key FROM k WHERE part = 'workspace' AND key IS NOT NULL), hs AS (SELECT key, arg_min(ts, import_id) AS seen FROM k WHERE part = 'history' AND key IS NOT NULL GROUP BY key) "


def keyed(s, d):
    k = frame(s, d, "imports", "im").withColumn("key", S.record_key(F.col("module"), F.col("site"), F.col("day")))
    part = F.when(F.col("import_id") < 200000, "history").when(F.col("import_id") < 200100, "workspace").otherwise("new")
    return k.withColumn("part", part)


def parts(s, d):
    k = keyed(s, d)
    return (k.where(F.col("part") == p) for p in ("new", "workspace", "history"))


@query("fn_rec_key", _KEYED + "SELECT uid, key FROM k")
def fn_rec_key(s, d):
    return keyed(s, d).select("uid", "key")


@query("jn_dup_detect", _KEYED + "SELECT uid, k.key, CASE WHEN ws.key IS NOT NULL THEN 'workspace' ELSE 'history' END AS found_in, CASE WHEN ws.key IS NULL THEN seen END AS seen FROM k LEFT JOIN ws USING (key) LEFT JOIN hs USING (key) WHERE part = 'new' AND (ws.key IS NOT NULL OR seen IS NOT NULL)")
def jn_dup_detect(s, d):
    return M.duplicates(*parts(s, d)).select("uid", "key", "found_in", "seen")


@query("jn_dup_skip", _KEYED + "SELECT uid, key FROM k WHERE part = 'new' AND (key IS NULL OR key NOT IN (SELECT key FROM ws))")
def jn_dup_skip(s, d):
    new, ws, _ = parts(s, d)
    return M.skip_duplicates(new, ws).select("uid", "key")


@query("jn_dup_overwrite", _KEYED + ", nw AS (SELECT DISTINCT key FROM k WHERE part = 'new' AND key IS NOT NULL) SELECT uid, key, part FROM k WHERE part = 'new' OR (part = 'workspace' AND (key IS NULL OR key NOT IN (SELECT key FROM nw)))")
def jn_dup_overwrite(s, d):
    new, ws, _ = parts(s, d)
    return M.overwrite_duplicates(new, ws).select("uid", "key", "part")


@query("set_append", _KEYED + "SELECT uid, part FROM k WHERE part = 'workspace' UNION ALL SELECT uid, part FROM k WHERE part = 'new'")
def set_append(s, d):
    new, ws, _ = parts(s, d)
    return ws.unionByName(new).select("uid", "part")


@query("agg_first_seen", _KEYED + "SELECT key, min(import_id) AS import_id, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY key")
def agg_first_seen(s, d):
    return keyed(s, d).where("key IS NOT NULL").groupBy("key").agg(F.min("import_id").alias("import_id"), F.count("*").alias("n"))


_HIST = duck("imports") + ", li AS (SELECT l_orderkey AS uid, count(*) AS c FROM lineitem GROUP BY 1), hs AS (SELECT import_id, max(ts) AS ts, count(DISTINCT im.uid) AS n_records, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows, CASE WHEN max(status) = 'exported' THEN '已匯出' WHEN max(missing_count) > 0 THEN '缺 ' || max(missing_count) || ' 欄' ELSE '未匯出' END AS status FROM im LEFT JOIN li ON li.uid = im.uid GROUP BY import_id) "


def history(s, d):
    items = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("item_idx"))
    return M.history_summary(frame(s, d, "imports", "im").join(items, "uid", "left"))


query("agg_history_summary", _HIST + "SELECT import_id, ts, n_records, n_rows, status FROM hs")(history)


@query("srt_history_topk", _HIST + "SELECT import_id, n_records, status, CAST(row_number() OVER (ORDER BY ts DESC, import_id) AS INTEGER) AS place FROM hs ORDER BY ts DESC, import_id LIMIT 20")
def srt_history_topk(s, d):
    return M.newest_first(history(s, d), 20).select("import_id", "n_records", "status", "place")


@query("agg_module_groups", duck("imports") + " SELECT import_id, module, min(uid) AS first_uid, count(*) AS n FROM im GROUP BY ALL")
def agg_module_groups(s, d):
    return frame(s, d, "imports", "im").groupBy("import_id", "module").agg(F.min("uid").alias("first_uid"), F.count("*").alias("n"))


@query("agg_module_string", duck("imports") + ", g AS (SELECT import_id, module, min(uid) AS o FROM im GROUP BY ALL) SELECT import_id, string_agg(module, '+' ORDER BY o) AS modules FROM g GROUP BY import_id")
def agg_module_string(s, d):
    return M.module_string(frame(s, d, "imports", "im").withColumnRenamed("uid", "ord"))


@query("agg_station_writeback", WATER_REC + """, w AS (SELECT *, sheet_id AS ord, CASE WHEN sheet_id % 4 > 0 THEN '1' || sheet_id % 10 || ':15' END AS te FROM rec),
g AS (SELECT site AS name, arg_max(coord_sys, ord) FILTER (coord_sys IS NOT NULL) AS c, arg_max(x, ord) FILTER (x IS NOT NULL) AS nx, arg_max(y, ord) FILTER (y IS NOT NULL) AS ny, arg_max(te, ord) FILTER (te IS NOT NULL) AS nt,
  list_sort(list_distinct(coalesce(list(station_raw) FILTER (station_raw <> site AND station_raw <> ''), []))) AS al FROM w GROUP BY site)
SELECT coalesce(st.name, g.name) AS name, CASE WHEN st.name IS NULL THEN 'P5' ELSE project_code END AS project_code, coalesce(c, coord_sys) AS coord_sys, coalesce(nx, x) AS x, coalesce(ny, y) AS y, coalesce(nt, last_end_time) AS last_end_time,
  array_to_string(CASE WHEN st.name IS NULL THEN [] ELSE [alias1, alias2] END || list_filter(coalesce(al, []), lambda a: st.name IS NULL OR (a <> alias1 AND a <> alias2)), ',') AS aliases FROM st FULL JOIN g ON st.name = g.name""")
def agg_station_writeback(s, d):
    te = F.when(F.col("sheet_id") % 4 > 0, F.concat(F.lit("1"), (F.col("sheet_id") % 10).cast("string"), F.lit(":15")))
    r = water_records(s, d).withColumn("ord", F.col("sheet_id")).withColumn("time_end", te)
    return M.write_back(r, stations(s, d), "P5").withColumn("aliases", F.array_join("aliases", ","))


_MERGE = "WITH df AS (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size % 2 = 0), b AS (SELECT p_partkey AS k FROM part WHERE p_size % 3 = 0), dt AS (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_size % 5 = 0) "


@query("set_threeway_merge", _MERGE + "SELECT k, v, FALSE AS added FROM dt UNION ALL SELECT k, v, TRUE FROM df WHERE k NOT IN (SELECT k FROM b) AND k NOT IN (SELECT k FROM dt)")
def set_threeway_merge(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    size, k = F.col("p_size"), F.col("p_partkey").alias("k")
    return M.merge_tables(p.where(size % 5 == 0).select(k, F.col("p_brand").alias("v")), p.where(size % 3 == 0).select(k), p.where(size % 2 == 0).select(k, F.col("p_name").alias("v")))


@query("edt_overlay", "WITH e AS (SELECT o_orderkey AS seq, o_custkey AS uid, CASE WHEN o_orderkey % 3 > 0 THEN 'v' || o_orderkey END AS nv FROM orders), l AS (SELECT uid, arg_max_null(nv, seq) AS nv FROM e GROUP BY uid) SELECT c_custkey AS uid, 'x' AS key, CASE WHEN l.uid IS NOT NULL THEN nv ELSE c_name END AS value, CASE WHEN l.uid IS NOT NULL THEN 'manual' ELSE 'parsed' END AS src FROM customer LEFT JOIN l ON l.uid = c_custkey")
def edt_overlay(s, d):
    items = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("uid"), F.lit("x").alias("key"), F.col("c_name").alias("value"), F.lit("parsed").alias("src"))
    o = s.read.parquet(f"{d}/orders.parquet")
    edits = o.select(F.col("o_custkey").alias("uid"), F.lit("x").alias("key"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))).alias("new_value"), F.col("o_orderkey").alias("seq"))
    return M.overlay(items, edits)


# Comparison: the second table shifts, drops and changes cells of the first.
_DIFF = "WITH e0 AS (SELECT s_suppkey AS k, unnest(['nation', 'bal', 'name']) AS col, unnest([s_nationkey, s_acctbal, NULL]) AS num, unnest([NULL, NULL, s_name]) AS txt FROM supplier), e AS (SELECT k, col, num, txt FROM e0), a AS (SELECT k, col, CASE WHEN k % 5 = 0 AND col = 'bal' THEN num + 1 ELSE num + 1e-12 END AS num, CASE WHEN k % 4 = 0 THEN '  ' ELSE txt END AS txt FROM e WHERE k % 9 > 0 UNION ALL SELECT 1000000 + n_nationkey, 'name', NULL, n_name FROM nation), "
_DIFF += "e2 AS (SELECT k, col, num, CASE WHEN trim(txt) <> '' THEN txt END AS txt FROM e WHERE num IS NOT NULL OR trim(txt) <> ''), a2 AS (SELECT k, col, num, CASE WHEN trim(txt) <> '' THEN txt END AS txt FROM a WHERE num IS NOT NULL OR trim(txt) <> ''), "
_DIFF += "j AS (SELECT coalesce(e2.k, a2.k) AS k, coalesce(e2.col, a2.col) AS col, CASE WHEN a2.k IS NULL THEN '{miss}' WHEN e2.k IS NULL THEN 'extra' WHEN coalesce(abs(e2.num - a2.num) < 1e-9, e2.txt = a2.txt, FALSE) THEN 'equal' ELSE 'different' END AS result FROM e2 FULL JOIN a2 ON e2.k = a2.k AND e2.col = a2.col) "


def tables(s, d):
    sup = s.read.parquet(f"{d}/supplier.parquet")
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cell = lambda c, n, t: F.struct(F.lit(c).alias("col"), n.alias("num"), t.alias("txt"))
    e = sup.select(F.col("s_suppkey").alias("k"), F.inline(F.array(cell("nation", F.col("s_nationkey").cast("double"), text), cell("bal", F.col("s_acctbal"), text), cell("name", none, F.col("s_name")))))
    k = F.col("k")
    a = e.where(k % 9 > 0).select("k", "col", F.when((k % 5 == 0) & (F.col("col") == "bal"), F.col("num") + 1).otherwise(F.col("num") + 1e-12).alias("num"), F.when(k % 4 == 0, "  ").otherwise(F.col("txt")).alias("txt"))
    n = s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 1000000).cast("long").alias("k"), F.lit("name").alias("col"), none.alias("num"), F.col("n_name").alias("txt"))
    return e, a.unionByName(n)


KNOWN = D.Deviations(("S3", "S13"), ("S11",), ("S6", "S12"), (("S7", "V"), ("S14", "V")), (("S5", "I2", "U"),), {"I4": ("M v1", "M v2")})


def sheet_cells(s, d):
    return frame(s, d, "sheets", "ecells"), frame(s, d, "sheets", "acells")


def sheets_at(s, d):
    """The same cells with their positions."""
    at = {"sheet": F.col("site"), "row": F.col("ln") * 2 + F.col("rep"), "col": F.instr(F.lit("RSUV"), F.col("col")) - 1}
    return tuple(c.withColumns(at) for c in sheet_cells(s, d))


_AT = duck("sheets") + ", " + ", ".join(f"{x}p AS (SELECT site AS sheet, ln * 2 + rep AS row, CAST(instr('RSUV', col) - 1 AS INTEGER) AS col, num, txt, format FROM {x}cells WHERE num IS NOT NULL OR txt IS NOT NULL)" for x in "ea") + " "
_FORMAT = lambda x: f"coalesce(regexp_replace({x}.format, ';@$', ''), 'General')"


@query("cmp_positional", _AT + f"SELECT coalesce(e.sheet, a.sheet) AS sheet, coalesce(e.row, a.row) AS row, coalesce(e.col, a.col) AS col, CASE WHEN a.sheet IS NULL THEN 'missing' WHEN e.sheet IS NULL THEN 'extra' WHEN coalesce(abs(e.num - a.num) < 1e-9, e.txt = a.txt, FALSE) THEN 'equal' ELSE 'different' END AS result, coalesce(e.num IS NOT NULL AND a.num IS NOT NULL AND {_FORMAT('e')} <> {_FORMAT('a')}, FALSE) AS format_differs FROM ep e FULL JOIN ap a ON e.sheet = a.sheet AND e.row = a.row AND e.col = a.col")
def cmp_positional(s, d):
    return D.positional(*sheets_at(s, d), format_columns=(1,))


@query("cmp_extents", _AT + ", x AS (SELECT sheet, max(row) AS r, max(col) AS c FROM ep GROUP BY sheet), y AS (SELECT sheet, max(row) AS r, max(col) AS c FROM ap GROUP BY sheet) SELECT * FROM (SELECT coalesce(x.sheet, y.sheet) AS sheet, coalesce(x.r, 0) AS row_expected, coalesce(x.c, 0) AS col_expected, coalesce(y.r, 0) AS row_actual, coalesce(y.c, 0) AS col_actual FROM x FULL JOIN y ON x.sheet = y.sheet) WHERE row_expected <> row_actual OR col_expected <> col_actual")
def cmp_extents(s, d):
    return D.extents(*sheets_at(s, d))


# One wide row a row of a sheet, cells of each column as a pair of number and text.
_WIDE = duck("sheets") + ", " + ", ".join(f"{x}w AS (SELECT site, item, row_no, " + ", ".join(f"max(num) FILTER (col = '{c}') AS {c}n, nullif(trim(max(txt) FILTER (col = '{c}')), '') AS {c}t" for c in "RSUV") + f" FROM {x}cells GROUP BY ALL)" for x in "ea")
_LEGACY = "site IN ('S6', 'S12') AND St LIKE '<%' AND Rt IS NULL"
_READ = f", ex AS (SELECT site, item, row_no, Rn, CASE WHEN {_LEGACY} THEN '<' ELSE Rt END AS Rt, CASE WHEN {_LEGACY} THEN CAST(trim(substr(St, 2)) AS DOUBLE) ELSE Sn END AS Sn, CASE WHEN {_LEGACY} THEN NULL ELSE St END AS St, Un, Ut, Vn, Vt FROM ew)"


def _paired(expected: str, deviation: str) -> str:
    """Cells of the output's rows and the first expected row of their key, by column; pairs without any value aren't there."""
    one = "SELECT a.site, a.item, a.row_no, '{c}' AS col, e.{c}n AS en, e.{c}t AS et, a.{c}n AS an, a.{c}t AS atx FROM aw a JOIN fe e ON e.site = a.site AND e.item = a.item"
    cells = " UNION ALL ".join(one.replace("{c}", c) for c in "RSUV")
    return (f", fe AS (SELECT * FROM {expected} QUALIFY row_number() OVER (PARTITION BY site, item ORDER BY row_no) = 1), cl AS (SELECT * FROM ({cells}) WHERE coalesce(CAST(en AS VARCHAR), et, CAST(an AS VARCHAR), atx) IS NOT NULL)"
            f", cr AS (SELECT site, item, row_no, col, CASE WHEN coalesce(abs(en - an) < 1e-9, et = atx, FALSE) THEN 'equal' {deviation} ELSE 'different' END AS result FROM cl)"
            ", ne AS (SELECT site, count(*) AS n FROM ew GROUP BY site), na AS (SELECT site, count(*) AS n FROM aw GROUP BY site)"
            ", xr AS (SELECT * FROM aw a WHERE site IN (SELECT site FROM ne) AND NOT EXISTS (SELECT 1 FROM fe WHERE fe.site = a.site AND fe.item = a.item)) ")


@query("cmp_by_station", _WIDE + _READ + _paired("ex", "WHEN en IS NULL AND et IS NULL AND ((site IN ('S7', 'S14') AND col = 'V') OR (site = 'S5' AND item = 'I2' AND col = 'U')) THEN 'deviation' WHEN col = 'U' AND item = 'I4' AND et IN ('M v1', 'M v2') AND atx IN ('M v1', 'M v2') THEN 'deviation'")
       + "SELECT * FROM cr UNION ALL SELECT site, item, row_no, NULL, 'extra row' FROM xr UNION ALL SELECT coalesce(ne.site, na.site), NULL, NULL, NULL, CASE WHEN na.n IS NULL THEN CASE WHEN ne.site IN ('S3', 'S13') THEN 'deviation' ELSE 'missing site' END WHEN ne.n IS NULL THEN 'extra site' ELSE 'row count' END FROM ne FULL JOIN na ON ne.site = na.site WHERE ne.n IS DISTINCT FROM na.n")
def cmp_by_station(s, d):
    return D.by_station(*sheet_cells(s, d), known=KNOWN)


_KEY = "'{\"site\":\"' || site || '\",\"item\":\"' || item || '\"}' AS item"


@query("cmp_by_block", _WIDE + _paired("ew", "") + f"SELECT site, {_KEY}, row_no, col, result FROM cr UNION ALL SELECT site, {_KEY}, row_no, NULL, 'extra row' FROM xr UNION ALL SELECT site, {_KEY}, row_no, NULL, 'missing row' FROM ew e WHERE site IN (SELECT site FROM na) AND NOT EXISTS (SELECT 1 FROM aw WHERE aw.site = e.site AND aw.item = e.item) UNION ALL SELECT coalesce(ne.site, na.site), NULL, NULL, NULL, CASE WHEN na.n IS NULL OR na.site = 'S11' THEN 'deviation' ELSE 'extra block' END FROM ne FULL JOIN na ON ne.site = na.site WHERE ne.n IS NULL OR na.n IS NULL")
def cmp_by_block(s, d):
    return D.by_block(*sheet_cells(s, d), ["site"], ["item"], KNOWN)


@query("cmp_verdict", _DIFF.replace("{miss}", "missing") + "SELECT count(*) AS compared, count(*) FILTER (result = 'equal') AS equal, count(*) FILTER (result IN ('different', 'missing', 'extra')) AS fails FROM j")
def cmp_verdict(s, d):
    r = F.col("result")
    return R.compare(*tables(s, d), ["k"]).agg(F.count("*").alias("compared"), F.count_if(r == "equal").alias("equal"), F.count_if(r != "equal").alias("fails"))


@query("set_whitelist", _DIFF.replace("{miss}", "missing") + "SELECT k, col, result, k IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AS known FROM j WHERE result <> 'equal'")
def set_whitelist(s, d):
    w = s.read.parquet(f"{d}/supplier.parquet").where("s_nationkey < 5").select(F.col("s_suppkey").alias("k"))
    return R.subtract_whitelist(R.compare(*tables(s, d), ["k"]).where("result <> 'equal'"), w, ["k"]).select("k", "col", "result", "known")


@query("lim_first_diffs", _DIFF.replace("{miss}", "missing") + "SELECT k, col, result FROM j WHERE result <> 'equal' ORDER BY k, col LIMIT 60")
def lim_first_diffs(s, d):
    return R.compare(*tables(s, d), ["k"]).where("result <> 'equal'").orderBy("k", "col").limit(60).select("k", "col", "result")


# Scalar functions over texts made from whole tables.
_TXT = "WITH t AS (SELECT p_partkey AS id, p_size AS n, CASE p_partkey % 9 WHEN 0 THEN ' 25.' || p_size WHEN 1 THEN 'ND' WHEN 2 THEN '1e' || p_size % 9 WHEN 3 THEN '.5' WHEN 4 THEN p_size || 'd' WHEN 5 THEN '' WHEN 6 THEN p_size || '.5 × 10' || p_size % 7 WHEN 7 THEN p_size || 'x103' ELSE 'NaN' END AS s, p_size || CASE WHEN p_partkey % 2 = 0 THEN ':' ELSE '：' END || (p_partkey % 70) AS hm, 'a' || p_size || '， b,,' || p_brand || ' ，' AS al FROM part) "


def texts(s, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    c = F.element_at(F.array(F.concat(F.lit(" 25."), n), F.lit("ND"), F.concat(F.lit("1e"), (F.col("p_size") % 9).cast("string")), F.lit(".5"), F.concat(n, F.lit("d")), F.lit(""),
                             F.concat(n, F.lit(".5 × 10"), (F.col("p_size") % 7).cast("string")), F.concat(n, F.lit("x103")), F.lit("NaN")), (k % 9 + 1).cast("int"))
    return s.read.parquet(f"{d}/part.parquet").select(k.alias("id"), F.col("p_size").alias("n"), c.alias("s"), F.concat(n, F.when(k % 2 == 0, ":").otherwise("："), (k % 70).cast("string")).alias("hm"), F.concat(F.lit("a"), n, F.lit("， b,,"), "p_brand", F.lit(" ，")).alias("al"))


for _name, _expr, _sql in (
    ("fn_to_number", lambda: S.to_number(F.col("s")), O.num("s")),
    ("fn_sci", lambda: S.sci(F.col("s")), f"TRY_CAST({O.ex(O.tr('s'), O.SCI)} AS DOUBLE) * pow(10, TRY_CAST({O.ex(O.tr('s'), O.SCI, 2)} AS DOUBLE))"),
    ("fn_norm_hm", lambda: S.norm_hm(F.col("hm")), "CASE WHEN regexp_matches(replace(hm, '：', ':'), '^([01]?[0-9]|2[0-3]):[0-5][0-9]$') THEN lpad(split_part(replace(hm, '：', ':'), ':', 1), 2, '0') || ':' || split_part(replace(hm, '：', ':'), ':', 2) END"),
    ("fn_alias_split", lambda: F.array_join(S.alias_list(F.col("al")), "|"), f"array_to_string(list_filter(list_transform(regexp_split_to_array(al, '[，,]'), lambda x: {O.tr('x')}), lambda x: x <> ''), '|')"),
    ("flt_blank", lambda: S.is_blank(F.col("s")), f"s IS NULL OR {O.tr('s')} = ''"),
    ("fn_json_copy", lambda: F.to_json(F.struct("id", F.col("n").alias("n"))), "'{\"id\":' || id || ',\"n\":' || n || '}'"),
    ("fn_crc32", lambda: F.crc32(F.col("hm").cast("binary")), None),
    ("fn_xml_escape", lambda: S.xml_escape(F.concat("s", F.lit('<&>"\n'))), "replace(replace(replace(replace(replace(s || '<&>\"' || chr(10), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(10), '&#10;')"),
    ("fn_edit_parse", lambda: F.to_json(F.struct(*[v.alias(k) for k, v in S.parse_edit(F.lit("time"), F.col("hm")).items()])), "CASE WHEN regexp_matches(replace(hm, '：', ':'), '^([01]?[0-9]|2[0-3]):[0-5][0-9]$') THEN '{\"txt\":\"' || lpad(split_part(replace(hm, '：', ':'), ':', 1), 2, '0') || ':' || split_part(replace(hm, '：', ':'), ':', 2) || '\"}' ELSE '{}' END"),
):
    QUERIES[_name] = lambda s, d, f=_expr: texts(s, d).select("id", f().alias("value"))
    if _sql:
        SQL[_name] = _TXT + f"SELECT id, {_sql} AS value FROM t"

# CRC-32 by its table, made from the polynomial, byte by byte.
SQL["fn_crc32"] = _TXT.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """, tab(i, n, c) AS (SELECT range, 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END FROM tab WHERE n < 8),
t8 AS (SELECT i, c FROM tab WHERE n = 8), u AS (SELECT id, hex(encode(hm)) AS h FROM t),
r(id, h, p, c) AS (SELECT id, h, 0, CAST(4294967295 AS BIGINT) FROM u UNION ALL SELECT r.id, r.h, r.p + 1, xor(t8.c, r.c >> 8) FROM r JOIN t8 ON t8.i = xor(r.c & 255, CAST('0x' || substr(r.h, r.p * 2 + 1, 2) AS BIGINT)) WHERE r.p * 2 < length(r.h))
SELECT id, xor(c, CAST(4294967295 AS BIGINT)) AS value FROM r WHERE p * 2 = length(h)"""

# The workspace.
simple("prj_vib_header", lambda s, d: E.vib_heads(noise(s, d)), "sheet_id, station_raw, category, date_start, time_start, date_end, time_end, ctrl_std, ctrl_zone, env_std, freq_range", O.noise, "vh")


@query("val_export_gate", _HIST + "SELECT im.uid, CASE WHEN nullif(project_code, '') IS NULL THEN 'blocked' WHEN missing_count > 0 THEN 'confirm' ELSE 'export' END AS gate, CASE WHEN missing_count > 0 THEN 'missing' WHEN nullif(project_code, '') IS NULL THEN 'no project' ELSE 'ready' END AS status FROM im")
def val_export_gate(s, d):
    im = frame(s, d, "imports", "im")
    m, p = F.col("missing_count"), F.col("project_code")
    return im.select("uid", K.export_gate(m, p).alias("gate"), K.status(F.lit(1), m, p).alias("status"))


@query("prj_preview_state", WATER_REC + "SELECT sheet_id, CASE WHEN x IS NULL THEN 'missing' ELSE 'memory' END AS x_state, CASE WHEN date_start IS NULL THEN 'missing' ELSE 'parsed' END AS date_state, 'missing' AS end_state FROM rec")
def prj_preview_state(s, d):
    yes, none, parsed, manual = F.lit(True), F.lit(None).cast("string"), F.lit("parsed"), F.lit("manual")
    state = lambda c, src, via: K.cell_state(F.col(c).cast("string"), yes, src, via)
    r = water_records(s, d)
    return r.select("sheet_id", state("x", manual, F.col("x_via")).alias("x_state"), state("date_start", parsed, none).alias("date_state"), state("time_end", manual, none).alias("end_state"))


@query("jn_rename_site", duck("stations") + ",\n" + O.STATION.strip() + ", o AS (SELECT o_orderkey AS id, c_name AS site, o_custkey AS ck FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT id AS sheet_id, CASE WHEN id % 4 = 0 THEN 'shared ' || ck % 50 WHEN id % 4 = 1 THEN 'nowhere' END AS new_site, site FROM o) SELECT sheet_id, coalesce(new_site, site) AS site, sm.coord_sys, CASE WHEN sheet_id % 5 = 0 THEN 1.0 ELSE sm.x END AS x, sm.y, CASE WHEN new_site IS NULL THEN 'parsed' ELSE 'manual' END AS src FROM r LEFT JOIN sm ON sm.match_name = new_site")
def jn_rename_site(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    o = s.read.parquet(f"{d}/orders.parquet").join(c, F.col("o_custkey") == F.col("c_custkey"))
    none = lambda t: F.lit(None).cast(t)
    k = F.col("o_orderkey")
    records = o.select(k.alias("sheet_id"), F.col("c_name").alias("station_raw"), none("int").alias("coord_sys"), F.when(k % 5 == 0, 1.0).alias("x"), none("double").alias("y"))
    new = F.when(k % 4 == 0, F.concat(F.lit("shared "), (F.col("o_custkey") % 50).cast("string"))).when(k % 4 == 1, "nowhere")
    edits = o.select(k.alias("sheet_id"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("first").alias("new_site")), F.struct(F.lit(2).alias("seq"), new.alias("new_site")))).alias("e")).where(k % 4 < 2).select("sheet_id", "e.*")
    return K.rename_site(records, edits, stations(s, d))


@query("edt_end_times", WATER_REC + ", t AS (SELECT name AS site, min('2' || ord % 4 || ':30') AS given FROM st WHERE ord % 2 = 0 GROUP BY name) SELECT sheet_id, rec.site, given AS time_end, CASE WHEN given IS NULL THEN 'parsed' ELSE 'manual' END AS time_src FROM rec LEFT JOIN t ON t.site = rec.site")
def edt_end_times(s, d):
    t = stations(s, d).where("ord % 2 = 0").select(F.col("name").alias("site"), F.concat(F.lit("2"), (F.col("ord") % 4).cast("string"), F.lit(":30")).alias("end_time"))
    return K.end_times(water_records(s, d), t).select("sheet_id", "site", "time_end", "time_src")


@query("fn_missing_message", _MISS + ", x AS (SELECT mi.*, rec.site, wit.item_name FROM mi JOIN rec USING (sheet_id) LEFT JOIN wit ON wit.sheet_id = mi.sheet_id AND wit.item_idx = mi.item_idx) SELECT sheet_id, item_idx, key, CASE WHEN item_idx IS NULL THEN site ELSE coalesce(site, '') || ' / ' || coalesce(item_name, '項目' || (item_idx + 1)) END AS message FROM x")
def fn_missing_message(s, d):
    r, i = water_records(s, d), E.water_items(water_body(s, d))
    m = R.missing(r, i, "water").join(r.select("sheet_id", "site"), "sheet_id").join(i.select("sheet_id", "item_idx", "item_name"), ["sheet_id", "item_idx"], "left")
    return m.select("sheet_id", "item_idx", "key", K.missing_message(F.col("site"), F.col("item_name"), F.col("item_idx")).alias("message"))


_ALL = "WITH a AS (" + " UNION ALL ".join(
    f"SELECT sheet_id * 10 + {_OWN[m]} AS sheet_id, '{m}' AS module, station_raw, {'site' if m == 'noise' else 'station_raw AS site'}, category, date_start, license FROM ({sql})" for m, sql in (
        ("water", O.water("SELECT * FROM wh")), ("air", O.air("SELECT * FROM ah")),
        ("noise", O.noise("").rstrip() + f", {_SITE} SELECT sheet_id, station_raw, site, category, date_start, license FROM ns UNION ALL SELECT sheet_id, station_raw, site, category, date_start, NULL FROM vs"))) + ") "


@query("src_ingest_all", _ALL + "SELECT sheet_id, module, station_raw, site, category, date_start, license, CASE WHEN site <> '' AND date_start <> '' THEN module || '|' || site || '|' || date_start END AS key FROM a")
def src_ingest_all(s, d):
    return K.ingest(mixed(s, d, titles=False), stations=sites(s, d)).select("sheet_id", "module", "station_raw", "site", "category", "date_start", "license", "key")


@query("agg_sheet_dimension", O.water("SELECT sheet_id, max(row_no) AS last_row, max(ascii(col) - 64) AS last_col, count(*) AS n FROM cells WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY sheet_id"))
def agg_sheet_dimension(s, d):
    c = water(s, d).where("num IS NOT NULL OR txt IS NOT NULL")
    return c.groupBy("sheet_id").agg(F.max("row_no").alias("last_row"), F.max(F.ascii("col") - 64).alias("last_col"), F.count("*").alias("n"))


@query("set_sheet_names", "WITH o AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS a, list(CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE o_orderpriority END ORDER BY o_orderkey) AS b FROM orders GROUP BY 1) SELECT k, a = b AS same FROM o")
def set_sheet_names(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    names = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", c.alias("n")))), lambda x: x["n"])
    p = F.col("o_orderpriority")
    g = o.groupBy(F.col("o_custkey").alias("k")).agg(names(p).alias("a"), names(F.when(F.col("o_orderkey") % 50 == 0, "x").otherwise(p)).alias("b"))
    return g.select("k", (F.col("a") == F.col("b")).alias("same"))


@query("fn_number_format", "SELECT p_partkey AS id, coalesce(regexp_replace(CASE p_partkey % 4 WHEN 0 THEN 'h:mm;@' WHEN 1 THEN 'mm-dd-yy' WHEN 2 THEN ';@0' END, ';@$', ''), 'General') AS value FROM part")
def fn_number_format(s, d):
    k = F.col("p_partkey") % 4
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), K.number_format(F.when(k == 0, "h:mm;@").when(k == 1, "mm-dd-yy").when(k == 2, ";@0")).alias("value"))


# Master data as people edit it.
_HM = lambda x: f"CASE WHEN regexp_matches(replace({x}, '：', ':'), '^([01]?[0-9]|2[0-3]):[0-5][0-9]$') THEN lpad(split_part(replace({x}, '：', ':'), ':', 1), 2, '0') || ':' || split_part(replace({x}, '：', ':'), ':', 2) END"
_FORMS = duck("stations", "forms") + f""", fo AS (SELECT *, {O.tr('name')} AS nm, {O.num('x')} AS nx, {O.num('y')} AS ny, {_HM('last_end_time')} AS hm FROM ff),
fe AS (SELECT *, CASE WHEN nm = '' THEN 'name' WHEN last_end_time <> '' AND hm IS NULL THEN 'time' WHEN (x <> '' AND nx IS NULL) OR (y <> '' AND ny IS NULL) THEN 'coordinates' END AS error FROM fo) """


def forms(s, d):
    return frame(s, d, "forms", "ff")


@query("val_station_form", _FORMS + "SELECT seq, nm AS name, error, CASE WHEN original <> nm THEN original END AS gone FROM fe WHERE op = 'put'")
def val_station_form(s, d):
    return G.station_forms(forms(s, d).where("op = 'put'")).select("seq", "name", "error", "gone")


@query("mgt_stations", _FORMS + """, ev AS (SELECT name, -1 AS seq, 0 AS step, true AS there, project_code, coord_sys, x, y, last_end_time, alias1 || '|' || alias2 AS aliases FROM st
UNION ALL SELECT original, seq, 1, false, NULL, NULL, NULL, NULL, NULL, NULL FROM fe WHERE op = 'delete' OR (error IS NULL AND original <> nm)
UNION ALL SELECT nm, seq, 2, true, nullif(project_code, ''), CAST(coord_sys AS INT), nx, ny, hm, 'a|b|' || right(aliases, 2) FROM fe WHERE op = 'put' AND error IS NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC, step DESC) AS rn FROM ev WHERE name IS NOT NULL) SELECT name, project_code, coord_sys, x, y, last_end_time, aliases FROM l WHERE rn = 1 AND there""")
def mgt_stations(s, d):
    f = forms(s, d)
    gone = f.where("op = 'delete'").select("seq", F.col("original").alias("gone"))
    return G.save(stations(s, d).select(*G.STATION), G.station_forms(f.where("op = 'put'")), "name", gone).withColumn("aliases", F.array_join("aliases", "|"))


_ROWS = "CASE o_orderkey % 5 WHEN 0 THEN '[[1,2,3,4,5,6,7,8]]' WHEN 1 THEN '[[1,2]]' WHEN 2 THEN '' WHEN 3 THEN '[]' ELSE '{' END"
_PROJECTS = f"SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS original, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'C' || o_custkey END AS code, {_ROWS} AS basic_rows, CASE WHEN o_orderkey % 7 = 0 THEN '2026/1/1' WHEN o_orderkey % 7 = 1 THEN '' ELSE '2026-01-31' END AS construction_date FROM "


@query("mgt_projects", "WITH f AS (" + _PROJECTS + """orders), fe AS (SELECT *, CASE WHEN code = ' ' THEN 'code' WHEN construction_date LIKE '%/%' THEN 'date' WHEN basic_rows IN ('[[1,2]]', '{') THEN 'rows' END AS error FROM f),
ev AS (SELECT DISTINCT o_orderpriority AS code, -1 AS seq, 0 AS step, true AS there, NULL AS construction_date, NULL AS basic_rows FROM orders UNION ALL SELECT original, seq, 1, false, NULL, NULL FROM fe WHERE error IS NULL AND original IS NOT NULL
UNION ALL SELECT code, seq, 2, true, nullif(construction_date, ''), nullif(basic_rows, '') FROM fe WHERE error IS NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq DESC, step DESC) AS rn FROM ev) SELECT code, construction_date, basic_rows FROM l WHERE rn = 1 AND there""")
def mgt_projects(s, d):
    f = s.read.parquet(f"{d}/orders.parquet").selectExpr(*[f"{e} AS {n}" for n, e in (
        ("seq", "o_orderkey"), ("original", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END"), ("code", "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'C' || CAST(o_custkey AS STRING) END"), ("basic_rows", _ROWS),
        ("construction_date", "CASE WHEN o_orderkey % 7 = 0 THEN '2026/1/1' WHEN o_orderkey % 7 = 1 THEN '' ELSE '2026-01-31' END"))])
    rest = {c: F.lit(None).cast("string") for c in G.PROJECT if c not in f.columns}
    old = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("code")).distinct().withColumns({c: F.lit(None).cast("string") for c in G.PROJECT[1:]})
    return G.save(old, G.project_forms(f.withColumns(rest)), "code").select("code", "construction_date", "basic_rows")


_TABLE = duck("editor") + f""", t AS (SELECT name, seq, numeric, {O.tr('k')} AS k, {O.tr('v')} AS v FROM er), u AS (SELECT *, CASE WHEN numeric THEN {O.num('v')} IS NULL ELSE v = '' END AS bad FROM t WHERE k <> '' OR v <> ''),
l AS (SELECT *, row_number() OVER (PARTITION BY name, k ORDER BY seq DESC, v DESC) AS rn FROM u WHERE name NOT IN (SELECT name FROM u WHERE bad)), tr AS (SELECT name, k, CASE WHEN numeric THEN {O.num('v')} END AS num, CASE WHEN NOT numeric THEN v END AS txt FROM l WHERE rn = 1) """


@query("fn_table_rows", _TABLE + "SELECT * FROM tr")
def fn_table_rows(s, d):
    return G.table_rows(frame(s, d, "editor", "er"))


@query("mgt_tables", _TABLE + """, de AS (SELECT DISTINCT 't' || p_size AS name, p_brand AS k, p_type AS v FROM part), sv AS (SELECT DISTINCT name, 3 AS version FROM tr), old AS (SELECT DISTINCT 't' || p_size AS name, 'data' AS part, p_brand AS k, 'old' AS v, 1 AS base_version FROM part)
SELECT * FROM old WHERE name NOT IN (SELECT name FROM sv) UNION ALL SELECT name, 'data', k, txt, version FROM tr JOIN sv USING (name) UNION ALL SELECT name, 'base', k, v, version FROM de JOIN sv USING (name)""")
def mgt_tables(s, d):
    rows = G.table_rows(frame(s, d, "editor", "er"))
    part = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("name"), F.col("p_brand").alias("k"), F.col("p_type").alias("v")).distinct()
    old = part.select("name", F.lit("data").alias("part"), "k", F.lit("old").alias("v"), F.lit(1).alias("base_version")).distinct()
    return G.save_tables(old, rows.select("name", "k", F.col("txt").alias("v")), part, rows.select("name").distinct().withColumn("version", F.lit(3)))


@query("mgt_reopen", duck("imports") + " SELECT import_id, uid, module, site, coalesce(nullif(project_code, ''), 'P9') AS project_code FROM im WHERE import_id = 199602")
def mgt_reopen(s, d):
    return G.reopen(frame(s, d, "imports", "im").withColumn("warnings", F.lit("w")), 199602, "P9").select("import_id", "uid", "module", "site", "project_code")


@query("mgt_delete_imports", duck("imports") + " SELECT import_id, count(*) AS n FROM im WHERE status <> 'exported' GROUP BY 1")
def mgt_delete_imports(s, d):
    im = frame(s, d, "imports", "im")
    return G.delete_imports(im, im.where("status = 'exported'")).groupBy("import_id").agg(F.count("*").alias("n"))


@query("snk_drafts", duck("imports") + """, old AS (SELECT DISTINCT import_id, ts, 'air' AS module, 'old' AS project_code, 9 AS missing_count, 'draft' AS status FROM im), r AS (SELECT * FROM im WHERE import_id % 2 = 0),
f AS (SELECT import_id, module, min(uid) AS ord FROM r GROUP BY 1, 2), g AS (SELECT import_id, string_agg(module, '+' ORDER BY ord) AS module FROM f GROUP BY 1), n AS (SELECT DISTINCT import_id, ts, project_code, missing_count, status FROM r)
SELECT import_id, ts, module, project_code, missing_count, status FROM n JOIN g USING (import_id) UNION ALL SELECT * FROM old WHERE import_id % 2 = 1""")
def snk_drafts(s, d):
    im = frame(s, d, "imports", "im")
    old = im.select("import_id", "ts", F.lit("air").alias("module"), F.lit("old").alias("project_code"), F.lit(9).alias("missing_count"), F.lit("draft").alias("status")).distinct()
    return G.save_drafts(old, im.where("import_id % 2 = 0").withColumn("ord", F.col("uid")))


@query("srt_import_order", O.water("SELECT sheet_id, item_idx, -(sheet_id % 100) AS file_ord, sheet_id AS sheet_ord FROM wit ORDER BY file_ord, sheet_ord, item_idx"))
def srt_import_order(s, d):
    i = E.water_items(water_body(s, d)).select("sheet_id", "item_idx")
    return G.in_import_order(i, i.select("sheet_id", (-(F.col("sheet_id") % 100)).alias("file_ord"), F.col("sheet_id").alias("sheet_ord")).distinct())

"""Inputs made from the driver's tables by SQL that Spark and DuckDB both read.

Tables are named in braces. Each fixture is a list of common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


#: Lists of cells made from one source: a union of selects for DuckDB, one generator for Spark.
_LISTS: list[tuple[str, list[tuple[str, str, str, str, str]]]] = []


def _cells(rows: list[tuple[str, str, str]], source: str) -> str:
    """A mark for cells with fixed addresses: address, number expression, text expression."""
    parts = [re.match(r"([A-Z]+)(\d+)", a).groups() for a, _, _ in rows]
    return _mark(source, [(f"'{a}'", f"'{c}'", r, n, t) for (a, n, t), (c, r) in zip(rows, parts, strict=True)])


def _mark(source: str, rows: list[tuple[str, str, str, str, str]]) -> str:
    _LISTS.append((source, rows))
    return f"@{len(_LISTS) - 1}@"


def _union(source: str, rows: list) -> str:
    return " UNION ALL ".join(f"SELECT sheet_id, {a} AS addr, {c} AS col, {r} AS row_no, CAST({n} AS DOUBLE) AS num, CAST({t} AS STRING) AS txt FROM {source}" for a, c, r, n, t in rows)


def _inline(source: str, rows: list) -> str:
    items = ", ".join(f"named_struct('addr', {a}, 'col', {c}, 'row_no', {r}, 'num', CAST({n} AS DOUBLE), 'txt', CAST({t} AS STRING))" for a, c, r, n, t in rows)
    return f"SELECT sheet_id, inline(filter(array({items}), c -> c.num IS NOT NULL OR c.txt IS NOT NULL)) FROM {source}"


def _expand(text: str, how) -> str:
    return re.sub(r"@(\d+)@", lambda m: how(*_LISTS[int(m[1])]), text)


_S = lambda x: f"CAST({x} AS STRING)"

FX: dict[str, str] = {}
FX["water"] = f"""
ws AS (SELECT o_orderkey AS sheet_id, min(c_name) AS cname, min(o_custkey) AS ck, CAST(min(year(o_orderdate)) + 20 - 1911 AS INT) AS y, CAST(min(month(o_orderdate)) AS INT) AS m, CAST(min(day(o_orderdate)) AS INT) AS d
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY o_orderkey),
wi AS (SELECT l_orderkey AS sheet_id, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS INT) AS q,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM {{lineitem}}),
wr AS (SELECT *, CAST(CASE WHEN sheet_id % 97 = 0 THEN rn + 194 WHEN sheet_id % 17 = 0 AND rn >= 3 THEN rn + 15 ELSE rn + 14 END AS INT) AS r FROM wi),
wv AS (SELECT sheet_id, r, pk,
  CASE WHEN sheet_id % 5 = 0 AND rn = 4 THEN '備註：樣品保存' WHEN pk % 7 = 0 THEN '溶氧' WHEN pk % 7 = 1 THEN '油脂(正己烷抽出物)' ELSE ' 項目' || {_S('pk % 7')} || '　' END AS a,
  CASE WHEN pk % 11 = 0 THEN q * 0.5 END AS cn,
  CASE pk % 11 WHEN 0 THEN NULL WHEN 1 THEN 'ND' WHEN 2 THEN ' nd' WHEN 3 THEN 'NA' WHEN 4 THEN '未檢測' WHEN 5 THEN '<0.' || {_S('q')} WHEN 6 THEN '< ' || {_S('q')} WHEN 7 THEN {_S('q')} || '.5×104'
    WHEN 8 THEN {_S('q')} || '.25' WHEN 9 THEN '無法判讀' ELSE '<' END AS ct,
  CASE WHEN sk % 4 = 0 THEN q * 0.25 END AS dn, CASE sk % 4 WHEN 0 THEN NULL WHEN 1 THEN '--' WHEN 2 THEN ' ─' ELSE '0.0' || {_S('q')} END AS dt,
  CASE pk % 10 WHEN 0 THEN '℃' WHEN 1 THEN 'mg P/L' WHEN 2 THEN 'mg CaCO3/L' WHEN 3 THEN 'μmho/cm' WHEN 4 THEN 'm3/min' WHEN 5 THEN 'CFU/100mL' WHEN 6 THEN '' WHEN 7 THEN 'ppm' ELSE 'mg/L' END AS e,
  CASE sk % 3 WHEN 0 THEN 'NIEA W455.52C' WHEN 1 THEN 'NIEA  W210.58A' ELSE '自訂 NIEA W1' END AS f FROM wr),
hcells AS (""" + _cells([
    ("A2", "NULL", f"CASE WHEN sheet_id % 11 = 0 THEN '無字號' ELSE '檢字第0' || {_S('ck % 210')} || '號' END"), ("A3", "NULL", "'水質檢測報告'"), ("F8", "NULL", "CASE WHEN sheet_id % 3 = 0 THEN '　' || cname || ' ' WHEN sheet_id % 3 = 1 THEN 'alias of ' || cname ELSE 'new ' || cname END"),
    ("B11", "NULL", "CASE sheet_id % 5 WHEN 0 THEN '河川水' WHEN 1 THEN '放流水' WHEN 2 THEN '地下水' WHEN 3 THEN '海水' ELSE '溫泉水' END"), ("J9", "y", "NULL"),
    ("K9", "CASE WHEN sheet_id % 13 > 0 THEN m END", "CASE WHEN sheet_id % 13 = 0 THEN '日' END"), ("L9", "NULL", f"{_S('d')} || '日'"), ("M9", "sheet_id % 24", "NULL"), ("N9", "NULL", _S("sheet_id % 60")),
], "ws") + "),\nicells AS (" + _mark("wv", [(f"'{c}' || {_S('r')}", f"'{c}'", "r", n, t) for c, n, t in (("A", "NULL", "a"), ("C", "cn", "ct"), ("D", "dn", "dt"), ("E", "NULL", "e"), ("F", "NULL", "f"))]) + "),\ncells AS (SELECT * FROM hcells UNION ALL SELECT * FROM icells)"
FX["air"] = f"""
av AS (SELECT user_id * 100000000 + year(ts) * 10000 + month(ts) * 100 + day(ts) AS sheet_id, user_id, CAST(year(ts) - 1911 AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, event_id FROM {{events}}),
ash AS (SELECT sheet_id, min(user_id) AS u, min(y) AS y, min(m) AS m, min(d) AS d FROM av GROUP BY sheet_id),
ai AS (SELECT sheet_id, event_id % 14 AS p, max(event_id) AS e FROM av GROUP BY sheet_id, event_id % 14),
ac AS (SELECT sheet_id, CASE p WHEN 0 THEN 'C41' WHEN 1 THEN 'D41' WHEN 2 THEN 'E41' WHEN 3 THEN 'F41' WHEN 4 THEN 'G41' WHEN 5 THEN 'H41' WHEN 6 THEN 'L41' WHEN 7 THEN 'M41' WHEN 8 THEN 'N41' WHEN 9 THEN 'O41' WHEN 10 THEN 'P41' WHEN 11 THEN 'W16' WHEN 12 THEN 'Q18' ELSE 'Q40' END AS addr,
  CASE WHEN e % 7 < 2 THEN CAST(e % 1000 AS DOUBLE) * 0.25 END AS num,
  CASE e % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'ND' WHEN 3 THEN '< 0.' || {_S('e % 90 + 1')} WHEN 4 THEN '--' WHEN 5 THEN '西北西' ELSE {_S('e % 300')} || '.5' END AS txt FROM ai),
cells AS (""" + _cells([
    ("A2", "NULL", "CASE WHEN u % 2 = 0 THEN '空氣品質檢測報告' END"), ("S2", "NULL", "CASE WHEN u % 2 = 1 THEN '24小時空氣品質檢測報告' END"), ("A3", "NULL", f"CASE WHEN u % 9 > 0 THEN '第00' || {_S('u % 210')} || '號' ELSE '字號' END"),
    ("M6", "NULL", f"CASE WHEN u % 8 = 0 THEN '站' || {_S('u')} ELSE '監測地點： 站' || {_S('u')} || ' ' END"), ("A19", "y", "NULL"), ("A22", "NULL", f"{_S('m')} || '月'"), ("A25", "d", "NULL"), ("A30", "y", "NULL"), ("A33", "m", "NULL"),
    ("A36", "NULL", f"CASE WHEN u % 12 = 5 THEN '日' ELSE {_S('d')} END"), ("B17", "NULL", f"CASE WHEN u % 24 < 10 THEN '0' ELSE '' END || {_S('u % 24')} || ' ~ 07'"), ("Q45", "NULL", f"CASE WHEN u % 3 > 0 THEN 'MDL：0.00' || {_S('u % 9 + 1')} ELSE 'MDL' END"),
], "ash") + " UNION ALL SELECT sheet_id, addr, substr(addr, 1, 1), CAST(substr(addr, 2) AS INT), num, txt FROM ac)"
FX["noise"] = f"""
nd AS (SELECT s_suppkey AS sk, s_name, s_acctbal, k FROM {{supplier}} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) t),
nn AS (SELECT sk * 10 + k AS sheet_id, * FROM nd), nv AS (SELECT sk * 10 + k + 5 AS sheet_id, * FROM nd),
cells AS (""" + _cells([
    ("C41", "NULL", "CASE WHEN sk % 7 = 3 THEN '其他' ELSE 'L日間' END"), ("B8", "NULL", "CASE sk % 3 WHEN 0 THEN '道路交通噪音' WHEN 1 THEN '環境噪音' END"), ("B10", "NULL", "CASE WHEN sk % 6 > 0 THEN '依據 NIEA P201.96C 辦理' ELSE '無' END"),
    ("B11", "NULL", "s_name || ' '"), ("L8", "NULL", f"CASE WHEN sk % 11 = 0 THEN '不明' WHEN sk % 13 = 0 THEN '2026.01.' || {_S('k')} ELSE '115.' || {_S('k')} || '.' || {_S('sk % 28 + 1')} || '(平日)' END"), ("N3", "NULL", f"CASE WHEN sk % 5 > 0 THEN '環署檢字第0' || {_S('sk')} || '號' END"),
    ("T13", "CASE WHEN sk % 4 > 0 THEN floor(s_acctbal) END", "CASE WHEN sk % 4 = 0 THEN '250000.5' END"), ("T14", "CASE WHEN sk % 8 > 0 THEN floor(s_acctbal) + k END", "CASE WHEN sk % 8 = 0 THEN '無' END"),
    ("C42", "(sk * k % 997) * 0.25 - 20", "NULL"), ("G42", "CASE WHEN sk % 9 > 0 THEN sk % 600 * 0.125 END", "CASE WHEN sk % 9 = 0 THEN '55.2' END"), ("K42", "sk % 500 * 0.0625", "NULL"),
    ("A47", "NULL", "CASE sk % 5 WHEN 0 THEN '第二類管制區，道路八公尺以上' WHEN 1 THEN '第3類 未滿八公尺' WHEN 2 THEN '第四類' WHEN 3 THEN '第1類' ELSE '一般' END"),
], "nn") + " UNION ALL " + _cells([
    ("A3", "NULL", "'環境振動測定報告'"), ("B5", "NULL", "s_name"), ("J6", "NULL", f"CASE WHEN sk % 11 = 0 THEN '無' WHEN sk % 13 = 0 THEN '2026.01.' || {_S('k')} ELSE '115.' || {_S('k')} || '.' || {_S('sk % 28 + 1')} END"),
    ("C34", "sk % 800 * 0.0625 - 5", "NULL"), ("I34", "NULL", "'40.1'"), ("B37", "NULL", "'備註'"), ("B39", "NULL", "CASE WHEN sk % 2 = 0 THEN '方法 NIEA P204.90C' END"), ("B41", "NULL", "'NIEA  P205.91C'"),
], "nv") + ")"
FX["stations"] = """
st AS (SELECT c_custkey AS ord, c_name AS name, CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN '' ELSE 'P' || CAST(c_nationkey AS STRING) END AS project_code,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 3 + 1 AS INT) END AS coord_sys, CASE WHEN c_custkey % 6 > 1 THEN c_acctbal END AS x, c_acctbal + 1 AS y, CASE WHEN c_custkey % 2 = 0 THEN '10:30' END AS last_end_time,
  'alias of ' || c_name AS alias1, 'shared ' || CAST(c_custkey % 50 AS STRING) AS alias2 FROM {customer})"""
FX["imports"] = """
im AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS import_id, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) * 1000 + 7 AS ts, o_orderkey AS uid, o_custkey, o_orderkey % 40 AS site_no,
  CASE o_orderkey % 3 WHEN 0 THEN 'air' WHEN 1 THEN 'water' ELSE 'noise' END AS module, CASE WHEN month(o_orderdate) % 3 = 0 THEN 'exported' ELSE 'draft' END AS status, CAST(month(o_orderdate) % 2 AS INT) * 4 AS missing_count,
  CASE month(o_orderdate) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'P1' END AS project_code, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'S' || CAST(o_custkey % 400 AS STRING) END AS site, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6) AS day FROM {orders})"""
FX["forms"] = """
ff AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 4 THEN 'delete' ELSE 'put' END AS op, CASE WHEN o_orderkey % 4 > 0 THEN c_name END AS original,
  CASE o_orderkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN c_name || ' moved' ELSE ' ' || c_name || ' ' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'P1' END AS project_code, CASE WHEN o_orderkey % 2 = 0 THEN '2' END AS coord_sys,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN ' 12.5 ' ELSE '250000' END AS x, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE '2750000.5' END AS y,
  CASE o_orderkey % 6 WHEN 0 THEN '9:05' WHEN 1 THEN '25:00' WHEN 2 THEN '' ELSE '10：30' END AS last_end_time, 'a, b，,c' || CAST(o_orderkey % 3 AS STRING) AS aliases
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey)"""
FX["editor"] = """
er AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 't' || CAST(l_orderkey % 500 AS STRING) AS name, l_orderkey % 2 = 0 AS numeric,
  CASE l_partkey % 6 WHEN 0 THEN ' ' ELSE ' k' || CAST(l_partkey % 40 AS STRING) END AS k,
  CASE WHEN l_partkey % 6 = 0 AND l_suppkey % 2 = 0 THEN '' WHEN l_orderkey % 500 < 200 AND l_suppkey % 9 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'x' ELSE ' ' END ELSE ' ' || CAST(l_suppkey AS STRING) || '.5' END AS v FROM {lineitem})"""

_VALUES = "CASE WHEN sk % 6 = 0 AND ln % 3 = 0 THEN NULL ELSE q END"
FX["sheets"] = f"""
sr AS (SELECT l_suppkey AS sk, CAST(l_linenumber AS INT) AS ln, CAST(l_orderkey % 2 AS INT) AS rep, max(CAST(l_quantity AS DOUBLE)) AS q FROM {{lineitem}} GROUP BY l_suppkey, l_linenumber, l_orderkey % 2),
sq AS (SELECT *, sk * 100 + ln * 10 + rep AS row_no, 'S' || {_S('sk')} AS site, 'I' || {_S('ln')} AS item FROM sr),
se AS (SELECT * FROM sq WHERE sk % 11 > 0 AND NOT (rep = 1 AND sk % 4 = 1) AND NOT (ln = 3 AND sk % 13 = 0)), sa AS (SELECT * FROM sq WHERE sk % 10 <> 3 AND NOT (ln = 2 AND sk % 8 = 0)),
ecells AS (SELECT sk, ln, rep, row_no, site, item, 'R' AS col, CAST(NULL AS DOUBLE) AS num, CASE WHEN ln % 3 = 0 AND sk % 6 > 0 THEN '<' END AS txt, CAST(NULL AS STRING) AS format FROM se
  UNION ALL SELECT sk, ln, rep, row_no, site, item, 'S', {_VALUES}, CASE WHEN sk % 6 = 0 AND ln % 3 = 0 THEN '< ' || {_S('CAST(q AS INT)')} END, CASE WHEN sk % 2 = 0 THEN 'h:mm;@' END FROM se
  UNION ALL SELECT sk, ln, rep, row_no, site, item, 'U', NULL, CASE WHEN sk % 5 = 0 AND ln = 2 THEN '  ' WHEN ln = 4 THEN 'M v1' ELSE 'M' END, NULL FROM se
  UNION ALL SELECT sk, ln, rep, row_no, site, item, 'V', NULL, CASE WHEN sk % 7 > 0 THEN 'n' END, NULL FROM se),
acells AS (SELECT sk, ln, rep, row_no, site, item, 'R' AS col, CAST(NULL AS DOUBLE) AS num, CASE WHEN ln % 3 = 0 THEN '<' END AS txt, CAST(NULL AS STRING) AS format FROM sa
  UNION ALL SELECT sk, ln, rep, row_no, site, item, 'S', CASE WHEN sk % 9 = 0 AND ln = 1 THEN q + 1 ELSE q + 1e-12 END, NULL, CASE WHEN sk % 3 = 0 THEN 'General' WHEN sk % 2 = 0 THEN 'h:mm' END FROM sa
  UNION ALL SELECT sk, ln, rep, row_no, site, item, 'U', NULL, CASE WHEN ln = 4 THEN 'M v2' ELSE 'M' END, NULL FROM sa
  UNION ALL SELECT sk, ln, rep, row_no, site, item, 'V', NULL, 'n', NULL FROM sa)"""


def duck(*names: str) -> str:
    """The fixtures as the head of a DuckDB query."""
    return _expand("WITH " + ",\n".join(FX[n] for n in names), _union).format(**{t: t for t in TABLES})


def frame(spark: SparkSession, sf_dir: str, name: str, table: str) -> DataFrame:
    text = _expand("WITH " + FX[name], _inline).format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES})
    return spark.sql(f"{text} SELECT * FROM {table}")

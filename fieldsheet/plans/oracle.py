"""Pieces of DuckDB SQL: the scalar functions and the extracted tables, written apart from the Spark side."""

from __future__ import annotations

from ..functions import lookups as L
from .fixtures import duck

WS = r"[\s\x{3000}\x{00A0}]"
tr = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
ex = lambda x, p, g=1: f"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', {g}) END"
li = lambda x: f"TRY_CAST({ex(tr(x), '^([+-]?[0-9]+)')} AS INTEGER)"
p2 = lambda x: f"CASE WHEN {x} < 10 AND {x} >= 0 THEN '0' || CAST({x} AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
num = lambda x: f"CASE WHEN regexp_matches({tr(x)}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({tr(x)} AS DOUBLE) END"
jn = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
roc = lambda y, m, d: f"CAST({li(y)} + 1911 AS VARCHAR) || '-' || {p2(li(m))} || '-' || {p2(li(d))}"
dot = lambda x: roc(*[ex(x, r"([0-9]{2,3})\s*[.]\s*([0-9]{1,2})\s*[.]\s*([0-9]{1,2})", g) for g in (1, 2, 3)])
lic = lambda x: f"TRY_CAST({ex(x, '第0*([0-9]+)號')} AS INTEGER)"
niea = lambda x: ex(x, r"(NIEA\s+[A-Z]+[0-9]+)")
r1 = lambda x: f"floor({x} * 10 + 0.5) / 10"


def case(table: dict, key: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + " END"


def pivot(addresses: tuple[str, ...], cte: str = "h") -> str:
    cols = ", ".join(f"max(num) FILTER (addr = '{a}') AS {a}_n, max(txt) FILTER (addr = '{a}') AS {a}_s, coalesce({tr(f'''coalesce(max(txt) FILTER (addr = '{a}'), {jn(f'''max(num) FILTER (addr = '{a}')''')})''')}, '') AS {a}" for a in addresses)
    return f"{cte} AS (SELECT sheet_id, {cols} FROM cells GROUP BY sheet_id)"


def ctes(*parts: str) -> str:
    return ",\n".join(parts)


WATER_HEAD = pivot(("A2", "A3", "F8", "B11", "J9", "K9", "L9", "M9", "N9")) + f""",
wh0 AS (SELECT *, {roc('J9', 'K9', 'L9')} AS dt, {p2(li('M9'))} || ':' || {p2(li('N9'))} AS tm, {case(L.SAMPLE_TYPES, 'B11')} AS cat FROM h WHERE contains(A3, '水質檢測報告')),
wh AS (SELECT sheet_id, F8 AS station_raw, coalesce(cat, B11) AS category, cat IS NOT NULL AS category_mapped, CASE WHEN tm IS NOT NULL THEN dt END AS date_start, CASE WHEN dt IS NOT NULL THEN tm END AS time_start,
  CASE WHEN tm IS NOT NULL THEN dt END AS date_end, {lic('A2')} AS license FROM wh0)"""
SCI = r"^([0-9.]+)\s*[×xX]\s*10([0-9]+)$"
WATER_ITEMS = f"""
r0 AS (SELECT sheet_id, row_no, {tr("max(txt) FILTER (col = 'A')")} AS name, max(num) FILTER (col = 'C') AS cn, max(txt) FILTER (col = 'C') AS ct, max(num) FILTER (col = 'D') AS dn, max(txt) FILTER (col = 'D') AS dt,
  coalesce({tr("max(txt) FILTER (col = 'E')")}, '') AS e, coalesce({tr("max(txt) FILTER (col = 'F')")}, '') AS f FROM cells WHERE row_no BETWEEN 15 AND 200 GROUP BY sheet_id, row_no),
r1 AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY row_no) AS n, count(*) FILTER (name LIKE '備註%') OVER (PARTITION BY sheet_id ORDER BY row_no) AS stop FROM r0 WHERE name IS NOT NULL),
r2 AS (SELECT *, {tr('ct')} AS t, coalesce(cn, TRY_CAST({ex(tr('ct'), SCI)} AS DOUBLE) * pow(10, TRY_CAST({ex(tr('ct'), SCI, 2)} AS DOUBLE)), {num('ct')}) AS val FROM r1 WHERE n = row_no - 14 AND stop = 0),
r3 AS (SELECT *, substr(t, 2) AS rest FROM r2),
wit AS (SELECT sheet_id, CAST(n - 1 AS INTEGER) AS item_idx, row_no, name AS raw_name, e AS unit_raw, f AS raw_method, coalesce({case(L.ITEM_NAMES, 'name')}, name) AS item_name, CAST({case(L.WATER_UNITS, 'e')} AS INTEGER) AS unit_code,
  CASE WHEN val IS NOT NULL THEN NULL WHEN upper(t) = 'ND' THEN 'ND' WHEN upper(t) = 'NA' OR t = '未檢測' THEN '未檢測' WHEN t LIKE '<%' THEN '<' END AS compare,
  CASE WHEN val IS NOT NULL THEN val WHEN t LIKE '<%' THEN {num('rest')} END AS value_num,
  CASE WHEN val IS NOT NULL THEN NULL WHEN upper(t) = 'ND' THEN 'ND' WHEN upper(t) = 'NA' OR t = '未檢測' THEN '未檢測' WHEN t LIKE '<%' THEN CASE WHEN {num('rest')} IS NULL THEN rest END ELSE ct END AS value_txt,
  dn AS mdl_num, CASE WHEN {tr('dt')} NOT IN ('--', '─', '-') THEN dt END AS mdl_txt, coalesce({case(L.METHOD_OVERRIDES, 'name')}, {ex('f', '^(NIEA' + chr(92) + 's+[A-Z]+[0-9]+)')}, f) AS method_out FROM r3)"""
PLAN = [c for _, c, _ in L.AIR_PLAN]
AIR = pivot(("A2", "S2", "A3", "M6", "A19", "A22", "A25", "A30", "A33", "A36", "B17", "Q45", *PLAN)) + f""",
a0 AS (SELECT *, {li("split_part(B17, '~', 1)")} AS hh, {li('A19')} AS y1, {li('A22')} AS m1, {li('A25')} AS d1, {li('A30')} AS y2, {li('A33')} AS m2, {li('A36')} AS d2 FROM h WHERE contains(A2, '空氣品質檢測報告') OR contains(S2, '空氣品質檢測報告')),
a1 AS (SELECT *, hh + y1 + m1 + d1 + y2 + m2 + d2 IS NOT NULL AS ok FROM a0),
ah AS (SELECT sheet_id, coalesce({tr(ex('M6', '監測地點[：:]' + chr(92) + 's*(.+)'))}, M6) AS station_raw, '大氣環境' AS category, CASE WHEN ok THEN (y1 + 1911) || '/' || m1 || '/' || d1 END AS date_start,
  CASE WHEN ok THEN {p2('hh')} || ':00' END AS time_start, CASE WHEN ok THEN (y2 + 1911) || '-' || {p2('m2')} || '-' || {p2('d2')} END AS date_end,
  CASE WHEN ok THEN CASE WHEN hh = 0 THEN '23' ELSE {p2('(hh - 1)')} END || ':59' END AS time_end, {lic('A3')} AS license FROM a1),
a2 AS (SELECT sheet_id, {ex('Q45', 'MDL[：:]' + chr(92) + 's*([0-9.]+)')} AS lim, unnest([{', '.join(f"{{'i': {i}, 'name': '{n}', 'n': {c}_n, 't': {c}_s, 'm': {str(m is not None).lower()}}}" for i, (n, c, m) in enumerate(L.AIR_PLAN))}]) AS p FROM a1),
a3 AS (SELECT sheet_id, p.i AS i, p.name AS name, p.n AS num, p.t AS txt, {tr('p.t')} AS t, CASE WHEN p.m THEN TRY_CAST(lim AS DOUBLE) END AS lim FROM a2),
a4 AS (SELECT *, num IS NULL AND (txt IS NULL OR t IN ('', '--')) AS miss, CASE WHEN t LIKE '<%' THEN {tr('substr(t, 2)')} ELSE t END AS v FROM a3),
ait AS (SELECT sheet_id, CAST(i AS INTEGER) AS item_idx, name AS item_name, CAST({case(L.AIR_UNITS, 'name')} AS INTEGER) AS unit_code, CASE WHEN num IS NULL AND NOT miss AND upper(t) <> 'ND' AND t LIKE '<%' THEN '<' END AS compare,
  CASE WHEN num IS NOT NULL THEN num WHEN NOT miss AND upper(t) <> 'ND' THEN {num('v')} END AS value_num, CASE WHEN num IS NOT NULL OR miss THEN NULL WHEN upper(t) = 'ND' THEN 'ND' WHEN {num('v')} IS NULL THEN v END AS value_txt,
  CASE WHEN num IS NULL AND NOT miss AND upper(t) = 'ND' THEN lim END AS mdl_num, {case(L.AIR_METHODS, 'name')} AS method_out, miss AS missing FROM a4)"""
_NC = "均能音量(Leq)"
NOISE = pivot(("C41", "A3", "B8", "B10", "B11", "L8", "N3", "T13", "T14", "C42", "G42", "K42", "A47", "B5", "J6", "C34", "I34", *[f"B{r}" for r in range(36, 43)])) + f""",
n0 AS (SELECT *, coalesce(T13_n, {num('T13_s')}) AS x, coalesce(T14_n, {num('T14_s')}) AS y, {ex('A47', '第([一二三四1234])類')} AS z FROM h WHERE contains(C41, 'L日') AND NOT contains(A3, '環境振動測定報告')),
nh AS (SELECT sheet_id, B11 AS station_raw, nullif(B8, '') AS category, {dot('L8')} AS date_start, '00:00' AS time_start, {dot('L8')} AS date_end, '23:59' AS time_end, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 3 END AS coord_sys, x, y,
  '噪音管制法第7條第1項' AS ctrl_std, '第' || translate(z, '一二三四', '1234') || '類' AS ctrl_zone, CASE WHEN B8 = '道路交通噪音' THEN CASE WHEN contains(A47, '八公尺以上') THEN 2 WHEN contains(A47, '未滿八公尺') THEN 1 ELSE 0 END ELSE 0 END AS env_std,
  '20 Hz 至 200 kHz' AS freq_range, {lic('N3')} AS license FROM n0),
nit AS (SELECT sheet_id, p.i AS item_idx, '{_NC}' AS char_type, p.p AS period, {r1('p.v')} AS value_num, 16 AS unit_code, method_out FROM (SELECT sheet_id, {niea('B10')} AS method_out, unnest([{{'i': 0, 'p': '日間', 'v': C42_n}}, {{'i': 1, 'p': '晚間', 'v': G42_n}}, {{'i': 2, 'p': '夜間', 'v': K42_n}}]) AS p FROM n0)),
v0 AS (SELECT * FROM h WHERE contains(A3, '環境振動測定報告')),
vh AS (SELECT sheet_id, B5 AS station_raw, '振動' AS category, {dot('J6')} AS date_start, '00:00' AS time_start, {dot('J6')} AS date_end, '23:59' AS time_end, '噪音管制法第7條第1項' AS ctrl_std, '無' AS ctrl_zone, 0 AS env_std, '無' AS freq_range FROM v0),
vit AS (SELECT sheet_id, p.i AS item_idx, p.c AS char_type, p.p AS period, {r1('p.v')} AS value_num, 159 AS unit_code, method_out FROM (SELECT sheet_id, coalesce({', '.join(niea(f'B{r}') for r in range(36, 43))}) AS method_out, unnest([{{'i': 0, 'c': 'Lvd(10)', 'p': '日間', 'v': C34_n}}, {{'i': 1, 'c': 'Lvn(10)', 'p': '夜間', 'v': I34_n}}]) AS p FROM v0))"""
STATION = """
sn0 AS (SELECT ord, name, coord_sys, x, y, last_end_time, unnest([name, alias1, alias2]) AS match_name FROM st),
sn AS (SELECT match_name, arg_min(ord, ord) AS ord FROM sn0 GROUP BY match_name),
sm AS (SELECT sn.match_name, st.* FROM sn JOIN st USING (ord))"""


def water(select: str) -> str:
    return f"{duck('water')},\n{WATER_HEAD},\n{WATER_ITEMS}\n{select}"


def air(select: str) -> str:
    return f"{duck('air')},\n{AIR}\n{select}"


def noise(select: str) -> str:
    return f"{duck('noise')},\n{NOISE}\n{select}"

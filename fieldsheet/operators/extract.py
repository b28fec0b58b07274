"""Extraction of records and items from the cells of water, air, noise and vibration sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lookups as L
from ..functions import scalars as S
from .cells import AIR_HEAD, NOISE_HEAD, VIB_HEAD, WATER_HEAD, any_text, header, text

FIRST_ITEM, LAST_ITEM = 15, 200


def lookup(table: dict, key: Column) -> Column:
    """A small fixed table as an expression; null if the key isn't there. Editable tables are joined
    instead, see ``master.lookup_join``."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def mapped(df: DataFrame, key: Column, out: str, tables: DataFrame | None, module: str, name: str) -> DataFrame:
    """``out``: what the module's table ``name`` has for ``key``, null if it has nothing. Without ``tables`` that is the
    default as an expression; else it is joined from rows ``module, name, k, v`` (``master.override``), of one key's rows
    the smallest value. Numbers stay numbers: a text in a table of numbers gives null."""
    default = L.DEFAULT_TABLES[module, name]
    if tables is None:
        return df.withColumn(out, lookup(default, key))
    kind = "int" if isinstance(next(iter(default.values())), int) else "string"
    t = tables.where((F.col("module") == module) & (F.col("name") == name)).groupBy(F.col("k").alias("_key")).agg(F.min(F.col("v").try_cast(kind)).alias(out))
    return df.withColumn("_key", key).join(t, "_key", "left").drop("_key")


def water_heads(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    h = mapped(header(cells, WATER_HEAD), text("B11"), "mapped", tables, "water", "sampleTypeMap")
    date, time = S.roc_date(any_text("J9"), any_text("K9"), any_text("L9")), S.hour_minute(any_text("M9"), any_text("N9"))
    both = date.isNotNull() & time.isNotNull()
    return h.where(text("A3").contains("水質檢測報告")).select(
        "sheet_id", text("F8").alias("station_raw"), F.coalesce("mapped", text("B11")).alias("category"), F.col("mapped").isNotNull().alias("category_mapped"),
        F.when(both, date).alias("date_start"), F.when(both, time).alias("time_start"), F.when(both, date).alias("date_end"), S.license_no(text("A2")).alias("license"),
    )


def water_rows(cells: DataFrame) -> DataFrame:
    """The item rows up to the first empty name, gap or remark: a running test, so no sheet is looped over."""
    c = cells.where(F.col("row_no").between(FIRST_ITEM, LAST_ITEM) & F.col("col").isin("A", "C", "D", "E", "F"))
    at = lambda col, v: F.max(F.when(F.col("col") == col, F.col(v)))
    rows = c.groupBy("sheet_id", "row_no").agg(*[at(k, v).alias(f"{k}_{v[0]}") for k in "ACDEF" for v in ("num", "txt")])
    rows = rows.withColumn("name", S.trim(F.coalesce("A_t", S.number_text(F.col("A_n"))))).where("name IS NOT NULL")
    w = Window.partitionBy("sheet_id").orderBy("row_no")
    remark = F.max(F.col("name").startswith("備註").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("remark", remark)
    return rows.where(f"n = row_no - {FIRST_ITEM - 1} AND remark = 0").withColumn("item_idx", (F.col("n") - 1).cast("int")).drop("n", "remark")


def water_items(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    r = water_rows(cells)
    s = lambda k: F.coalesce(S.trim(F.coalesce(F.col(f"{k}_t"), S.number_text(F.col(f"{k}_n")))), F.lit(""))
    # Columns that are read many times below stay columns, so each text is read once.
    r = r.withColumns({"t": S.trim(F.col("C_t")), "value": S.water_value(F.col("C_n"), F.col("C_t")), "e": s("E"), "f": s("F")})
    for key, out, name in (("name", "known_name", "itemNameMap"), ("e", "unit_code", "unitCodes"), ("name", "method", "methodOverrides")):
        r = mapped(r, F.col(key), out, tables, "water", name)
    value = S.censor_water(F.col("C_n"), F.col("C_t"), F.col("t"), F.col("value"))
    return r.select(
        "sheet_id", "item_idx", "row_no", F.col("name").alias("raw_name"), F.col("e").alias("unit_raw"), F.col("f").alias("raw_method"),
        F.coalesce("known_name", "name").alias("item_name"), "unit_code",
        *[c.alias(k) for k, c in value.items()], F.col("D_n").alias("mdl_num"), S.mdl_text(F.col("D_t")).alias("mdl_txt"),
        S.method_code(F.col("name"), F.col("f"), F.col("method")).alias("method_out"),
    )


def air_heads(cells: DataFrame) -> DataFrame:
    h = header(cells, AIR_HEAD).where(text("A2").contains("空氣品質檢測報告") | text("S2").contains("空氣品質檢測報告"))
    i = lambda a: S.lead_int(any_text(a))
    hour = S.lead_int(F.split(text("B17"), "~")[0])
    ok = F.concat(*[F.coalesce(i(a).cast("string"), F.lit("?")) for a in ("A19", "A22", "A25", "A30", "A33", "A36")], F.coalesce(hour.cast("string"), F.lit("?"))).contains("?")
    good = lambda c: F.when(~ok, c)
    site = S.trim(S.extract(text("M6"), r"監測地點[：:]\s*(.+)"))
    return h.select(
        "sheet_id", F.coalesce(site, text("M6")).alias("station_raw"), site.isNotNull().alias("site_found"), F.lit(L.AIR_CATEGORY).alias("category"),
        good(F.concat((i("A19") + 1911).cast("string"), F.lit("/"), i("A22").cast("string"), F.lit("/"), i("A25").cast("string"))).alias("date_start"),
        good(F.concat(S.pad2(hour), F.lit(":00"))).alias("time_start"),
        good(F.concat((i("A30") + 1911).cast("string"), F.lit("-"), S.pad2(i("A33")), F.lit("-"), S.pad2(i("A36")))).alias("date_end"),
        good(S.end_time(hour)).alias("time_end"), S.license_no(text("A3")).alias("license"),
    )


def air_items(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """All items of the plan for every sheet, whether they have a reading or not."""
    h = header(cells, AIR_HEAD).where(text("A2").contains("空氣品質檢測報告") | text("S2").contains("空氣品質檢測報告"))
    limit = S.to_number(S.extract(text("Q45"), r"MDL[：:]\s*([\d.]+)"))
    plan = F.array(*[F.struct(F.lit(i).alias("item_idx"), F.lit(n).alias("item_name"), F.col(f"{c}_n").alias("num"), F.col(f"{c}_s").alias("txt"), F.when(F.lit(m is not None), limit).alias("limit")) for i, (n, c, m) in enumerate(L.AIR_PLAN)])
    t = h.select("sheet_id", F.inline(plan))
    for out, name in (("unit_code", "unitMap"), ("method_out", "methodMap")):
        t = mapped(t, F.col("item_name"), out, tables, "air", name)
    v = S.censor_air(F.col("num"), F.col("txt"))
    return t.select(
        "sheet_id", "item_idx", "item_name", "unit_code", v["compare"].alias("compare"), v["value_num"].alias("value_num"), v["value_txt"].alias("value_txt"),
        F.when(v["nd"], F.col("limit")).alias("mdl_num"), "method_out", v["missing"].alias("missing"),
    )


def _levels(cells: list[tuple[str, str, str]], unit: int, method: Column) -> Column:
    level = lambda a: S.round1(F.col(f"{a}_n"))  # noqa: E731  a level that is a text is none
    return F.inline(F.array(*[F.struct(F.lit(i).alias("item_idx"), F.lit(k).alias("char_type"), F.lit(p).alias("period"), level(a).alias("value_num"), F.lit(unit).alias("unit_code"), method.alias("method_out")) for i, (a, k, p) in enumerate(cells)]))


def constants(h: DataFrame, tables: DataFrame | None) -> DataFrame:
    """The two constants of noise sheets, which can be edited like any table."""
    return mapped(mapped(h, F.lit("管制標準"), "ctrl_std", tables, "noise", "constMap"), F.lit("頻率範圍(噪音)"), "freq_range", tables, "noise", "constMap")


def noise_heads(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    h = constants(header(cells, NOISE_HEAD), tables).where(text("C41").contains("L日") & ~text("A3").contains("環境振動測定報告"))
    x, y = (F.coalesce(F.col(f"{a}_n"), S.to_number(F.col(f"{a}_s"))) for a in ("T13", "T14"))
    category = F.nullif(text("B8"), F.lit(""))
    date = S.roc_dot(text("L8"))
    return h.select(
        "sheet_id", text("B11").alias("station_raw"), category.alias("category"), date.alias("date_start"), F.lit("00:00").alias("time_start"), date.alias("date_end"), F.lit("23:59").alias("time_end"),
        F.when(x.isNotNull() & y.isNotNull(), 3).alias("coord_sys"), x.alias("x"), y.alias("y"), "ctrl_std",
        S.zone(text("A47")).alias("ctrl_zone"), S.env_std(category, text("A47")).alias("env_std"), "freq_range", S.license_no(text("N3")).alias("license"),
    )


def noise_items(cells: DataFrame) -> DataFrame:
    h = header(cells, NOISE_HEAD).where(text("C41").contains("L日") & ~text("A3").contains("環境振動測定報告"))
    k = "均能音量(Leq)"
    return h.select("sheet_id", _levels([("C42", k, "日間"), ("G42", k, "晚間"), ("K42", k, "夜間")], L.NOISE_UNIT, S.niea(text("B10"))))


def vib_method() -> Column:
    """The first method named in the remarks."""
    return F.coalesce(*[S.niea(text(f"B{r}")) for r in range(36, 43)])


def vib_heads(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    h = constants(header(cells, VIB_HEAD), tables).where(text("A3").contains("環境振動測定報告"))
    date, none = S.roc_dot(text("J6")), F.lit(None)
    return h.select(
        "sheet_id", text("B5").alias("station_raw"), F.lit("振動").alias("category"), date.alias("date_start"), F.lit("00:00").alias("time_start"), date.alias("date_end"), F.lit("23:59").alias("time_end"),
        none.cast("int").alias("coord_sys"), none.cast("double").alias("x"), none.cast("double").alias("y"), "ctrl_std",
        F.lit("無").alias("ctrl_zone"), F.lit(0).alias("env_std"), F.lit("無").alias("freq_range"), none.cast("int").alias("license"),
    )


def vib_items(cells: DataFrame) -> DataFrame:
    h = header(cells, VIB_HEAD).where(text("A3").contains("環境振動測定報告"))
    return h.select("sheet_id", _levels([("C34", "Lvd(10)", "日間"), ("I34", "Lvn(10)", "夜間")], L.VIBRATION_UNIT, vib_method()))


def vib_mates(records: DataFrame, vibration: DataFrame, order: str = "sheet_id") -> DataFrame:
    """Vibration records with what the first noise record of the same site and day has and they lack.

    Both have their canonical ``site`` (``master.match_station``), so an alias on one of
    two sheets finds its mate. Null dates match null dates. The build side is one row a
    site and day, taken by an aggregation, so that records without dates don't multiply."""
    first = records.groupBy("site", "date_start").agg(F.min_by(F.struct("coord_sys", "x", "y", "license"), order).alias("mate"))
    m = first.select(F.col("site").alias("_site"), F.col("date_start").alias("_date"), "mate")
    v = vibration.join(m, F.col("site").eqNullSafe(F.col("_site")) & F.col("date_start").eqNullSafe(F.col("_date")), "left")
    for k in ("coord_sys", "x", "y", "license"):
        v = v.withColumn(k, F.coalesce(F.col(k), F.col(f"mate.{k}")))
    return v.withColumn("has_mate", F.col("mate").isNotNull()).drop("_site", "_date", "mate")

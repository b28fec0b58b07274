"""Warnings of extraction, by sheet: ``sheet_id, warning, n``.

Records come from ``master.match_station`` (a coordinate with an origin was blank on the
sheet). Kinds that concern items are counted; a sheet without any warning gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _flags(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """A row for each kind that holds of a row."""
    tests = F.array(*[F.struct(F.lit(k).alias("warning"), F.coalesce(c, F.lit(False)).alias("holds")) for k, c in kinds.items()])
    return df.select("sheet_id", F.inline(tests)).where("holds").groupBy("sheet_id", "warning").agg(F.count("*").alias("n"))


def _station() -> Column:
    return F.expr("NOT known AND (coord_sys IS NULL OR x IS NULL OR y IS NULL)")


def water(records: DataFrame, items: DataFrame) -> DataFrame:
    head = {"category": ~F.col("category_mapped"), "time": F.col("date_start").isNull(), "license": F.col("license").isNull(), "station": _station()}
    none = records.join(items, "sheet_id", "left_anti")
    return _flags(records, head).unionByName(_flags(items, {"unit": F.col("unit_code").isNull()})).unionByName(_flags(none, {"items": F.lit(True)}))


def air(records: DataFrame, items: DataFrame) -> DataFrame:
    """``midnight``: the end of a measurement from 00:00 is a guess."""
    head = {
        "site": ~F.col("site_found"), "license": F.col("license").isNull(), "time": F.col("date_start").isNull(),
        "midnight": F.col("time_start") == "00:00", "station": _station(),
    }
    own = {"value": F.col("missing"), "unit": F.col("unit_code").isNull(), "method": F.col("method_out").isNull()}
    return _flags(records, head).unionByName(_flags(items, own))


def _levels(items: DataFrame) -> DataFrame:
    first = F.col("item_idx") == 0  # the method is the sheet's
    return _flags(items, {"value": F.col("value_num").isNull(), "method": first & F.col("method_out").isNull()})


def noise(records: DataFrame, items: DataFrame) -> DataFrame:
    """``road``: a road's width isn't told."""
    head = {
        "site": F.col("station_raw") == "", "category": F.col("category").isNull(), "time": F.col("date_start").isNull(), "license": F.col("license").isNull(),
        "x": F.col("x").isNull() | F.col("x_via").isNotNull(), "y": F.col("y").isNull() | F.col("y_via").isNotNull(), "zone": F.col("ctrl_zone").isNull(),
        "road": (F.col("category") == "道路交通噪音") & (F.col("env_std") == 0), "station": _station(),
    }
    return _flags(records, head).unionByName(_levels(items))


def vibration(records: DataFrame, mated: DataFrame, items: DataFrame) -> DataFrame:
    """``mated``: the records with their mates (``extract.vib_mates``); the station's coordinates are judged before."""
    head = {"site": F.col("station_raw") == "", "time": F.col("date_start").isNull(), "station": _station()}
    return _flags(records, head).unionByName(_flags(mated, {"mate": ~F.col("has_mate")})).unionByName(_levels(items))

"""Validation, report rows and table comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class ColumnMeta:
    key: str
    level: str
    type: str
    required: bool


def _columns(text: str) -> list[ColumnMeta]:
    """``key:level type`` with * for required; types: d date, t time, n number, a number or text, s text."""
    out = []
    for part in text.split():
        key, _, kind = part.partition(":")
        out.append(ColumnMeta(key.rstrip("*"), "station" if kind[0] == "s" else "item", kind[1:], key.endswith("*")))
    return out


_COMMON = "unit_code*:in unit_other:is compare:is value*:ia mdl:ia method_out*:is license*:sn agency_other:is"
COLUMNS = {
    "water": _columns("date_start*:sd time_start*:st date_end*:sd time_end*:st site*:ss coord_sys*:sn x*:sn y*:sn depth:sn water_depth:sn ems:ss category*:ss item_name*:is " + _COMMON),
    "air": _columns("date_start*:ss time_start*:ss date_end*:sd time_end*:st site*:ss coord_sys*:sn x*:sn y*:sn place_no:ss site_height:sn sampling_height:sn ems:ss stack_no:ss category*:ss item_name*:is " + _COMMON),
    "noise": _columns("date_start*:sd time_start*:st date_end*:sd time_end*:st site*:ss coord_sys*:sn x*:sn y*:sn ctrl_std*:ss ctrl_zone*:ss env_std:sn freq_range:ss char_type*:is category*:ss period*:is value*:in unit_code*:in unit_other:is method_out*:is license*:sn agency_other:is"),
}


def missing(records: DataFrame, items: DataFrame, module: str) -> DataFrame:
    """``sheet_id, item_idx, key`` of every required field that is blank: station fields once a record,
    item fields for each item. Columns that a table lacks are blank."""

    def melt(df: DataFrame, level: str) -> DataFrame:
        keys = [c.key for c in COLUMNS[module] if c.required and c.level == level]
        idx = F.col("item_idx").cast("int") if level == "item" else F.lit(None).cast("int")
        value = lambda k: F.coalesce(F.col("value_num").cast("string"), F.col("value_txt")) if k == "value" and "value_txt" in df.columns else F.col("value_num").cast("string") if k == "value" else F.col(k).cast("string") if k in df.columns else F.lit(None).cast("string")
        # The test is above the generator, so each field is worked out once.
        fields = F.array(*[F.struct(F.lit(k).alias("key"), value(k).alias("v")) for k in keys])
        return df.select("sheet_id", idx.alias("item_idx"), F.inline(fields)).where(S.is_blank(F.col("v"))).drop("v")

    return melt(records, "station").unionByName(melt(items, "item"))


def flatten(records: DataFrame, items: DataFrame) -> DataFrame:
    """A row an item, the station's values on each; records without items give none."""
    return records.join(items, "sheet_id")


def cell_type(kind: str, num: Column, txt: Column) -> dict[str, Column]:
    """The type and content of a report cell: s text, n number, d date serial, tm time serial."""
    if kind == "d":
        return {"t": F.when(txt.isNull(), "s").otherwise("d"), "v": S.date_serial(txt).cast("double")}
    if kind == "t":
        return {"t": F.when(txt.isNull(), "s").otherwise("tm"), "v": S.time_serial(txt)}
    return {"t": F.when(num.isNotNull(), "n").otherwise("s"), "v": num}


def basic_rows(projects: DataFrame, module: str) -> DataFrame:
    """The project sheet: its own rows if it has any (not for water), else one of its fields."""
    names = ("code", "doc_no", "doc_name", "status", "construction_date", "completion_date", "operation_date", "note")
    own = F.array(*[F.col(n).cast("string") for n in names])
    rows = F.array(own) if module == "water" else F.when(F.size(F.coalesce("basic_rows", F.expr("array()"))) > 0, F.col("basic_rows")).otherwise(F.array(own))
    p = projects.select(F.col("code").alias("project"), F.posexplode(rows).alias("row_idx", "r"))
    return p.select("project", "row_idx", *[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)])


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Cells ``(*keys, col, num, txt)`` of two tables that differ, by class. Numbers are equal within
    the tolerance, a number and a text never are, blank texts are no value."""
    e, a = (d.withColumn("txt", F.when(~S.is_blank(F.col("txt")), F.col("txt"))).where("num IS NOT NULL OR txt IS NOT NULL").withColumn("here", F.lit(True)) for d in (expected, actual))
    on = [*keys, "col"]
    j = e.alias("e").join(a.alias("a"), on, "full_outer")
    same = F.coalesce(F.abs(F.col("e.num") - F.col("a.num")) < tolerance, F.col("e.txt") == F.col("a.txt"), F.lit(False))
    kind = F.when(F.col("a.here").isNull(), "missing").when(F.col("e.here").isNull(), "extra").when(~same, "different").otherwise("equal")
    return j.select(*on, kind.alias("result"), F.coalesce("e.txt", S.number_text(F.col("e.num"))).alias("expected"), F.coalesce("a.txt", S.number_text(F.col("a.num"))).alias("actual"))


def subtract_whitelist(diffs: DataFrame, whitelist: DataFrame, keys: list[str]) -> DataFrame:
    """Known deviations are marked, the rest stay failures."""
    w = whitelist.select(*keys).distinct().withColumn("known", F.lit(True))
    return diffs.join(w, keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))

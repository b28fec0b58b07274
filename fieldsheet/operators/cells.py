"""Sheets as long tables of cells: ``sheet_id, addr, col, row_no, kind, num, txt``.

``kind`` is 'n' for a number in ``num`` and 's' for a text in ``txt``. Reading fixed
addresses is one aggregation over the few cells that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lookups import AIR_PLAN

#: All addresses of headers and fixed plans.
WATER_HEAD = ("A2", "A3", "F8", "B11", "J9", "K9", "L9", "M9", "N9")
AIR_HEAD = ("A2", "S2", "A3", "M6", "A19", "A22", "A25", "A30", "A33", "A36", "B17", "Q45", *[c for _, c, _ in AIR_PLAN])
NOISE_HEAD = ("C41", "A3", "B8", "B10", "B11", "L8", "N3", "T13", "T14", "C42", "G42", "K42", "A47")
VIB_HEAD = ("A3", "B5", "J6", "C34", "I34", *[f"B{r}" for r in range(36, 43)])
ROUTE = ("A2", "A3", "S2", "C41")


def header(cells: DataFrame, addresses: Iterable[str]) -> DataFrame:
    """A row a sheet with columns ``<addr>_n`` and ``<addr>_s``; the filter reaches the scan."""
    addresses = tuple(dict.fromkeys(addresses))
    at = lambda a, c: F.max(F.when(F.col("addr") == a, F.col(c)))
    aggs = [x for a in addresses for x in (at(a, "num").alias(f"{a}_n"), at(a, "txt").alias(f"{a}_s"))]
    return cells.where(F.col("addr").isin(*addresses)).groupBy("sheet_id").agg(*aggs)


def text(a: str) -> Column:
    """The cell as a trimmed text, '' if it is empty."""
    return F.coalesce(S.trim(any_text(a)), F.lit(""))


def any_text(a: str) -> Column:
    return F.coalesce(F.col(f"{a}_s"), S.number_text(F.col(f"{a}_n")))


def route(cells: DataFrame, modules: tuple[str, ...] = ("water", "air", "noise")) -> DataFrame:
    """``sheet_id, module``: the first module that recognises the sheet, null if none does."""
    h = cells.select("sheet_id").distinct().join(header(cells, ROUTE), "sheet_id", "left")
    tests = {
        "water": text("A3").contains("水質檢測報告"),
        "air": text("A2").contains("空氣品質檢測報告") | text("S2").contains("空氣品質檢測報告"),
        "noise": text("C41").contains("L日") | text("A3").contains("環境振動測定報告"),
    }
    module = F.coalesce(*[F.when(tests[m], F.lit(m)) for m in tests if m in modules], F.lit(None).cast("string"))
    vib = F.when(module == "noise", text("A3").contains("環境振動測定報告"))
    return h.select("sheet_id", module.alias("module"), vib.alias("is_vibration"))

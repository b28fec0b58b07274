"""Comparison of report sheets: cell by cell, by station and item, and by blocks of rows.

Sheets are long tables of cells with ``col, num, txt``. Numbers are equal within a
tolerance; a number never equals a text. By station and by block, blank texts are no
value and rows without values aren't there; cell by cell, a blank text is a text.

``result`` is 'equal', 'deviation' (a difference that is known) or the name of a failure.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .workspace import number_format

TOLERANCE = 1e-9


@dataclass(frozen=True)
class Deviations:
    """What is known to differ, by the names of sites, columns and items."""

    expected_sites: tuple[str, ...] = ()
    output_sites: tuple[str, ...] = ()
    legacy_sites: tuple[str, ...] = ()
    columns: tuple[tuple[str, str], ...] = ()
    cells: tuple[tuple[str, str, str], ...] = ()
    methods: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _same(e: str, a: str) -> Column:
    null = lambda c: F.col(f"{c}.num").isNull() & F.col(f"{c}.txt").isNull()
    number = F.abs(F.col(f"{e}.num") - F.col(f"{a}.num")) < TOLERANCE
    return F.coalesce(number, F.col(f"{e}.txt") == F.col(f"{a}.txt"), null(e) & null(a))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def positional(expected: DataFrame, actual: DataFrame, format_columns: tuple[int, ...] = ()) -> DataFrame:
    """``sheet, row, col, result, format_differs`` of all cells ``sheet, row, col, num, txt, format`` of both.
    Formats are compared of numbers in ``format_columns``, without marks that mean nothing."""
    side = lambda d, name: d.select("sheet", "row", "col", F.struct("num", "txt", "format").alias(name))
    j = side(expected.where("num IS NOT NULL OR txt IS NOT NULL"), "e").join(side(actual.where("num IS NOT NULL OR txt IS NOT NULL"), "a"), ["sheet", "row", "col"], "full_outer")
    result = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(_same("e", "a"), "equal").otherwise("different")
    numbers = F.col("e.num").isNotNull() & F.col("a.num").isNotNull() & F.col("col").isin(*format_columns)
    return j.select("sheet", "row", "col", result.alias("result"), F.coalesce(numbers & (number_format(F.col("e.format")) != number_format(F.col("a.format"))), F.lit(False)).alias("format_differs"))


def extents(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Sheets whose last row or column, counted from 0, differ; a sheet without cells ends at the first."""
    end = lambda d, s: d.where("num IS NOT NULL OR txt IS NOT NULL").groupBy("sheet").agg(F.max("row").alias(f"row_{s}"), F.max("col").alias(f"col_{s}"))
    j = end(expected, "expected").join(end(actual, "actual"), "sheet", "full_outer").na.fill(0)
    return j.where("row_expected <> row_actual OR col_expected <> col_actual")


def _keyed(cells: DataFrame, block: list[str], row: list[str]) -> DataFrame:
    txt = F.when(~S.is_blank(F.col("txt")), F.col("txt"))
    key = lambda names: F.to_json(F.struct(*names))  # noqa: E731  one key that is never null
    return cells.withColumn("txt", txt).where("num IS NOT NULL OR txt IS NOT NULL").withColumns({"_block": key(block), "_row": key([*block, *row])})


def _parts(e: DataFrame, a: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of both by block, the output's rows with the first expected row of their key, and their cells."""
    rows = lambda d: d.groupBy("_block", "_row", "row_no").agg(*[F.first(n).alias(n) for n in names])
    er, ar = rows(e), rows(a)
    site = F.struct(*names).alias("of")
    count = lambda d, c: d.groupBy("_block").agg(F.count("*").alias(c), F.min(site).alias(f"{c}_of"))
    blocks = count(er, "n_expected").join(count(ar, "n_actual"), "_block", "full_outer")
    first = er.groupBy("_row").agg(F.min("row_no").alias("_first"))
    pairs = ar.join(first, "_row", "left")
    found = pairs.where("_first IS NOT NULL").select("_row", "row_no", "_first")
    cell = F.struct("num", "txt")
    want = e.select("_row", F.col("row_no").alias("_first"), "col", cell.alias("e")).join(found, ["_row", "_first"]).select("_row", "row_no", "col", "e")
    got = a.join(found, ["_row", "row_no"], "left_semi").select("_row", "row_no", "col", cell.alias("a"))
    cells = want.join(got, ["_row", "row_no", "col"], "full_outer").join(ar.select("_row", "row_no", *names), ["_row", "row_no"])
    return blocks, pairs.join(blocks.where("n_expected IS NOT NULL").select("_block"), "_block", "left_semi"), cells


def _out(df: DataFrame, result: Column, site: Column, item: Column | None = None, col: Column | None = None, row: Column | None = None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return df.select(site.alias("site"), (none("string") if item is None else item).alias("item"), (none("long") if row is None else row.cast("long")).alias("row_no"), (none("string") if col is None else col).alias("col"), result.alias("result"))


def by_station(expected: DataFrame, actual: DataFrame, known: Deviations = Deviations(), compare_column: str = "R", value_column: str = "S", method_column: str = "U") -> DataFrame:
    """``site, item, row_no, col, result`` over cells ``site, item, row_no, col, num, txt``: each output row against the
    first expected row of its site and item. 'missing site', 'extra site', 'extra row' and 'row count' are failures of
    no cell; a site's missing rows show in its number of rows. Rows without a site take no part. At ``legacy_sites``
    a value spelt "< x" with no comparison beside it is read as both."""
    e, a = (_keyed(d.where("site IS NOT NULL"), ["site"], ["item"]) for d in (expected, actual))
    number = S.to_number(F.regexp_replace("txt", r"^<\s*", ""))
    old = e.where(F.col("site").isin(*known.legacy_sites) & (F.col("col") == value_column) & F.col("txt").rlike(r"^<") & number.isNotNull())
    old = old.join(e.where(F.col("col") == compare_column).select("_row", "row_no"), ["_row", "row_no"], "left_anti")
    none = F.lit(None)
    read = old.select("_row", "row_no", F.inline(F.array(F.struct(F.lit(value_column).alias("col"), number.alias("num"), none.cast("string").alias("txt")), F.struct(F.lit(compare_column).alias("col"), none.cast("double").alias("num"), F.lit("<").alias("txt")))))
    read = read.join(old.select("_row", "row_no", "_block", "site", "item"), ["_row", "row_no"])
    names = ["_block", "_row", "site", "item", "row_no", "col", "num", "txt"]
    e = e.select(*names).join(read.select("_row", "row_no", "col"), ["_row", "row_no", "col"], "left_anti").select(*names).unionByName(read.select(*names))
    blocks, rows, cells = _parts(e, a, ["site", "item"])
    site = F.coalesce("n_expected_of.site", "n_actual_of.site")
    whole = F.when(F.col("n_actual").isNull(), F.when(site.isin(*known.expected_sites), "deviation").otherwise("missing site")).when(F.col("n_expected").isNull(), "extra site").otherwise("row count")
    c, i = F.col("col"), F.col("item")
    unfilled = F.col("e").isNull() & _any([(F.col("site") == s) & (c == k) for s, k in known.columns] + [(F.col("site") == s) & (i == n) & (c == k) for s, n, k in known.cells])
    spelt = (c == method_column) & _any([(i == n) & F.col("e.txt").isin(*v) & F.col("a.txt").isin(*v) for n, v in known.methods.items()])
    result = F.when(_same("e", "a"), "equal").when(unfilled | spelt, "deviation").otherwise("different")
    return (
        _out(blocks.where("NOT n_expected <=> n_actual"), whole, site)
        .unionByName(_out(rows.where("_first IS NULL"), F.lit("extra row"), F.col("site"), i, row=F.col("row_no")))
        .unionByName(_out(cells, result, F.col("site"), i, c, F.col("row_no")))
    )


def by_block(expected: DataFrame, actual: DataFrame, block: list[str], row: list[str], known: Deviations = Deviations()) -> DataFrame:
    """The same by blocks of rows (``block``, whose first column is the site) and rows within them. Blocks that are only
    expected are deviations, those only in the output failures ('extra block') but for ``output_sites``; within a block of
    both, rows that either lacks are failures. ``item`` is the row's key as JSON."""
    e, a = (_keyed(d, block, row) for d in (expected, actual))
    blocks, rows, cells = _parts(e, a, [block[0]])
    site = F.coalesce(f"n_expected_of.{block[0]}", f"n_actual_of.{block[0]}")
    whole = F.when(F.col("n_actual").isNull(), "deviation").otherwise(F.when(site.isin(*known.output_sites), "deviation").otherwise("extra block"))
    shared = blocks.where("n_expected IS NOT NULL AND n_actual IS NOT NULL").select("_block")
    lacking = e.select("_block", "_row", "row_no", block[0]).distinct().join(shared, "_block", "left_semi").join(a.select("_row"), "_row", "left_anti")
    result = F.when(_same("e", "a"), "equal").otherwise("different")
    of, key, at = F.col(block[0]), F.col("_row"), F.col("row_no")
    return (
        _out(blocks.where("n_expected IS NULL OR n_actual IS NULL"), whole, site)
        .unionByName(_out(rows.where("_first IS NULL"), F.lit("extra row"), of, key, row=at))
        .unionByName(_out(lacking, F.lit("missing row"), of, key, row=at))
        .unionByName(_out(cells, result, of, key, F.col("col"), at))
    )

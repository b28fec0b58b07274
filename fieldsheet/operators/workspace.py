"""What a user of the workspace sees and decides: status, export gate, cell states, renames, end times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import master


def status(rows: Column, missing: Column, project: Column) -> Column:
    """The state of a workspace: empty, missing, no project, ready."""
    return F.when(F.coalesce(rows, F.lit(0)) == 0, "empty").when(missing > 0, "missing").when(S.is_blank(project), "no project").otherwise("ready")


def export_gate(missing: Column, project: Column, allow_blank: bool = False) -> Column:
    """Whether a report may be written: it needs a project, and consent if fields are blank."""
    blank = F.lit("export") if allow_blank else F.lit("confirm")
    return F.when(S.is_blank(project), "blocked").when(missing > 0, blank).otherwise("export")


def cell_state(value: Column, required: Column, src: Column, via: Column) -> Column:
    """How a cell of the preview is marked."""
    return F.when(required & S.is_blank(value), "missing").when((src == "manual") & (via == "memory"), "memory").when(src == "manual", "manual").otherwise("parsed")


def rename_site(records: DataFrame, edits: DataFrame, stations: DataFrame) -> DataFrame:
    """Records with the last edited site name; what they still lack is filled from the station of that
    name or alias, whatever project it has."""
    last = edits.groupBy("sheet_id").agg(F.max_by("new_site", "seq").alias("new_site"))
    r = records.join(last, "sheet_id").withColumn("station_raw", F.col("new_site")).drop("new_site")
    rest = records.join(last.select("sheet_id"), "sheet_id", "left_anti")
    done = master.match_station(r, stations).select("sheet_id", F.col("station_raw").alias("site"), "coord_sys", "x", "y", F.lit("manual").alias("src"))
    return done.unionByName(rest.select("sheet_id", F.col("station_raw").alias("site"), "coord_sys", "x", "y", F.lit("parsed").alias("src")))


def end_times(records: DataFrame, times: DataFrame) -> DataFrame:
    """The end time given for a site, as if it was typed in."""
    t = times.groupBy("site").agg(F.min("end_time").alias("given"))
    j = records.join(t, "site", "left")
    return j.withColumn("time_end", F.coalesce("given", "time_end")).withColumn("time_src", F.when(F.col("given").isNotNull(), "manual").otherwise("parsed")).drop("given")


def number_format(x: Column) -> Column:
    """A cell's number format without the marks that mean nothing."""
    return F.coalesce(F.regexp_replace(x, ";@$", ""), F.lit("General"))


def missing_message(site: Column, item: Column, index: Column) -> Column:
    """The site, and for an item its name or its number."""
    name = F.coalesce(item, F.concat(F.lit("項目"), (index + 1).cast("string")))
    return F.when(index.isNull(), site).otherwise(F.concat(F.coalesce(site, F.lit("")), F.lit(" / "), name))


def ingest(cells: DataFrame, modules: tuple[str, ...] = ("water", "air", "noise"), stations: DataFrame | None = None) -> DataFrame:
    """The records of all recognised sheets with what modules share: one lazy plan for all modules. The key
    is made of the canonical ``site``, so that a record under an alias is the same record."""
    from . import cells as C
    from . import extract as E

    routed = C.route(cells, modules)
    cols = ("sheet_id", "station_raw", "category", "date_start", "time_start", "license")
    heads = [E.water_heads(cells), E.air_heads(cells), E.noise_heads(cells), E.vib_heads(cells)]
    all_heads = heads[0].select(*cols)
    for h in heads[1:]:
        all_heads = all_heads.unionByName(h.select(*cols))
    site = F.col("station_raw")
    if stations is not None:
        names = master.station_names(stations).select(F.col("match_name").alias("station_raw"), F.col("name").alias("_name"))
        all_heads, site = all_heads.join(names, "station_raw", "left"), F.coalesce("_name", "station_raw")
    out = routed.where("module IS NOT NULL").join(all_heads.select(*cols, site.alias("site")), "sheet_id")
    return out.withColumn("key", S.record_key(F.col("module"), F.col("site"), F.col("date_start")))

"""Master data: stations, editable tables, duplicates, history, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions.lookups import DEFAULT_TABLES


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; only one row a key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def in_scope(project: Column, active: str | None) -> Column:
    """Stations of no project or of the active one."""
    own = F.nullif(project, F.lit(""))
    return own.isNull() | (own.eqNullSafe(F.lit(active)))


def same_project(project: Column, active: str | None) -> Column:
    """History of just this project; no project matches no project."""
    return F.nullif(project, F.lit("")).eqNullSafe(F.nullif(F.lit(active), F.lit("")))


def station_names(stations: DataFrame) -> DataFrame:
    """Each name or alias with the first station that has it."""
    s = stations.withColumn("match_name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.expr("array()")))))
    return first_per(s.select("match_name", "ord", "name", "coord_sys", "x", "y", "last_end_time"), ["match_name"], ["ord"])


def match_station(records: DataFrame, stations: DataFrame) -> DataFrame:
    """``site``, filled coordinates with their origin, and whether the station is known."""
    m = station_names(stations).select("match_name", F.struct("name", "coord_sys", "x", "y", "last_end_time").alias("st"))
    r = records.join(m, records["station_raw"] == m["match_name"], "left")
    out = r.withColumn("site", F.coalesce("st.name", "station_raw")).withColumn("known", F.col("st").isNotNull())
    for k in ("coord_sys", "x", "y"):
        filled = F.col(k).isNull() & F.col(f"st.{k}").isNotNull()
        out = out.withColumn(f"{k}_via", F.when(filled, "memory")).withColumn(k, F.coalesce(F.col(k), F.col(f"st.{k}")))
    return out.withColumn("last_end_time", F.col("st.last_end_time")).drop("st", "match_name")


def table_rows(spark: SparkSession, tables: dict = DEFAULT_TABLES) -> DataFrame:
    """The editable tables as rows ``module, name, k, v``."""
    rows = [(m, n, k, str(v)) for (m, n), t in tables.items() for k, v in t.items()]
    return spark.createDataFrame(rows, "module string, name string, k string, v string")


def override(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """A stored table replaces its default as a whole."""
    return defaults.join(stored.select("module", "name").distinct(), ["module", "name"], "left_anti").unionByName(stored)


def lookup_join(df: DataFrame, table: DataFrame, key: str, out: str) -> DataFrame:
    """``out``: the table's value of ``key``, null if it has none. Spark broadcasts it if it is small."""
    t = table.select(F.col("k").alias("_k"), F.col("v").alias(out))
    return df.join(t, df[key] == t["_k"], "left").drop("_k")


def merge_tables(data: DataFrame, base: DataFrame, defaults: DataFrame) -> DataFrame:
    """New defaults join a customised table unless they were known or are there: nothing changes, and
    nothing that was deleted comes back."""
    new = defaults.join(base.select("k"), "k", "left_anti").join(data.select("k"), "k", "left_anti")
    return data.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))


def duplicates(new: DataFrame, workspace: DataFrame, history: DataFrame) -> DataFrame:
    """New records that the workspace has, else that history has, with the first import."""
    ws = workspace.select("key").where("key IS NOT NULL").distinct().withColumn("ws", F.lit(True))
    hist = history.where("key IS NOT NULL").groupBy("key").agg(F.min_by("ts", "import_id").alias("seen"))
    d = new.where("key IS NOT NULL").join(ws, "key", "left").join(hist, "key", "left")
    where = F.when(F.col("ws"), "workspace").when(F.col("seen").isNotNull(), "history")
    return d.withColumn("found_in", where).where("found_in IS NOT NULL").withColumn("seen", F.when(F.col("found_in") == "history", F.col("seen"))).drop("ws")


def skip_duplicates(new: DataFrame, workspace: DataFrame) -> DataFrame:
    """Records that the workspace has go; what only history has stays, as do records without a key."""
    return new.join(workspace.select("key").where("key IS NOT NULL").distinct(), "key", "left_anti")


def overwrite_duplicates(new: DataFrame, workspace: DataFrame) -> DataFrame:
    return workspace.join(new.select("key").where("key IS NOT NULL").distinct(), "key", "left_anti").unionByName(new)


def history_summary(imports: DataFrame) -> DataFrame:
    """``import_id, ts, n_records, n_rows, status`` from rows of items (null item: a record without)."""
    g = imports.groupBy("import_id").agg(
        F.max("ts").alias("ts"), F.countDistinct("uid").alias("n_records"), F.count("item_idx").alias("n_rows"), F.max("status").alias("_s"), F.max("missing_count").alias("_m"))
    text = F.when(F.col("_s") == "exported", "已匯出").when(F.col("_m") > 0, F.concat(F.lit("缺 "), F.col("_m").cast("string"), F.lit(" 欄"))).otherwise("未匯出")
    return g.select("import_id", "ts", "n_records", "n_rows", text.alias("status"))


def write_back(records: DataFrame, stations: DataFrame, active: str | None) -> DataFrame:
    """Stations after an export: the last value that isn't null of each field, and the new aliases."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"new_{c}")
    alias = F.array_sort(F.collect_set(F.when((F.col("station_raw") != "") & (F.col("station_raw") != F.col("site")), F.col("station_raw"))))
    g = records.where(~S.is_blank(F.col("site"))).groupBy(F.col("site").alias("name")).agg(last("coord_sys"), last("x"), last("y"), last("time_end"), alias.alias("new_aliases"))
    j = stations.join(g, "name", "full_outer")
    have = F.coalesce("aliases", F.expr("array()"))
    return j.select(
        "name", F.when(F.col("ord").isNull(), F.lit(active)).otherwise(F.col("project_code")).alias("project_code"),
        *[F.coalesce(f"new_{c}", c).alias(c) for c in ("coord_sys", "x", "y")], F.coalesce("new_time_end", "last_end_time").alias("last_end_time"),
        F.concat(have, F.array_except(F.coalesce("new_aliases", F.expr("array()")), have)).alias("aliases"))


def overlay(items: DataFrame, edits: DataFrame) -> DataFrame:
    """The last edit of a cell wins, also if it empties it."""
    last = edits.groupBy("uid", "key").agg(F.max_by("new_value", "seq").alias("new_value")).withColumn("edited", F.lit(True))
    j = items.join(last, ["uid", "key"], "left")
    edited = F.coalesce("edited", F.lit(False))
    return j.select("uid", "key", F.when(edited, F.col("new_value")).otherwise(F.col("value")).alias("value"), F.when(edited, "manual").otherwise(F.col("src")).alias("src"))


def module_string(records: DataFrame) -> DataFrame:
    """The modules of each import in order of appearance, joined by '+'."""
    g = records.groupBy("import_id", "module").agg(F.min("ord").alias("ord")).groupBy("import_id").agg(F.sort_array(F.collect_list(F.struct("ord", "module"))).alias("m"))
    return g.select("import_id", F.coalesce(F.nullif(F.array_join(F.transform("m", lambda x: x["module"]), "+"), F.lit("")), F.lit("water")).alias("modules"))


def newest_first(df: DataFrame, n: int) -> DataFrame:
    w = Window.orderBy(F.desc("ts"), "import_id")
    return df.orderBy(F.desc("ts"), "import_id").limit(n).withColumn("place", F.row_number().over(w))

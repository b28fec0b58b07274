"""Master data as people edit it: stations, projects, lookup tables, drafts, history and import order.

Forms hold texts as typed. A form with an error changes nothing; the others count in order of ``seq``.
Text that the rules don't read as a number or time is an error, null is a blank field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

STATION = ("name", "project_code", "coord_sys", "x", "y", "last_end_time", "aliases")
PROJECT = ("code", "doc_no", "doc_name", "status", "construction_date", "completion_date", "operation_date", "note", "basic_rows")
#: Values of a row of basic data.
BASIC_COLUMNS = 8


def typed(c: str) -> Column:
    """A field without the blanks around it; a null field is blank."""
    return S.trim(F.coalesce(F.col(c), F.lit("")))


def filled(c: str) -> Column:
    return F.nullif(typed(c), F.lit(""))


def apply_edits(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``rows`` after ``edits``: each takes away the key ``gone``, then puts its row under its own key (null: neither).

    What happened last to a key decides (of edits with an equal ``seq`` one that puts, then the larger row), so one
    aggregation by key does for any number of edits.
    """
    cols = rows.columns
    at = lambda seq, step: F.struct(seq.cast("long").alias("seq"), F.lit(step).alias("step")).alias("_at")
    row = F.struct(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in cols])
    none = F.when(F.lit(False), row)
    happened = rows.select(F.col(key).alias("_k"), at(F.lit(None), 0), row.alias("_row"))
    happened = happened.unionByName(edits.where("gone IS NOT NULL").select(F.col("gone").alias("_k"), at(F.col("seq"), 1), none.alias("_row")))
    happened = happened.unionByName(edits.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), at(F.col("seq"), 2), row.alias("_row")))
    return happened.groupBy("_k").agg(F.max(F.struct("_at", "_row")).alias("_last")).where("_last._row IS NOT NULL").select("_last._row.*")


def _renames(original: Column, key: Column) -> Column:
    return F.when(original != key, original)


def station_forms(forms: DataFrame) -> DataFrame:
    """Edits ``seq, gone, error`` and the station's columns from forms ``seq, original`` and the same columns as texts."""
    coords = [F.when(filled(c).isNotNull(), S.to_number(typed(c))) for c in ("x", "y")]
    wrong = [filled(c).isNotNull() & n.isNull() for c, n in zip(("x", "y"), coords, strict=True)]
    time = S.norm_hm(typed("last_end_time"))
    error = F.when(filled("name").isNull(), "name").when(filled("last_end_time").isNotNull() & time.isNull(), "time").when(wrong[0] | wrong[1], "coordinates")
    return forms.select(
        "seq", _renames(F.col("original"), typed("name")).alias("gone"), error.alias("error"), typed("name").alias("name"), F.nullif(F.col("project_code"), F.lit("")).alias("project_code"),
        filled("coord_sys").try_cast("int").alias("coord_sys"), coords[0].alias("x"), coords[1].alias("y"), time.alias("last_end_time"), S.alias_list(typed("aliases")).alias("aliases"))


def project_forms(forms: DataFrame) -> DataFrame:
    """The same for projects; dates are YYYY-MM-DD, basic data a JSON array of rows of eight values."""
    dates = [c for c in PROJECT if c.endswith("_date")]
    bad_date = F.lit(False)
    for c in dates:
        bad_date = bad_date | (filled(c).isNotNull() & ~typed(c).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    rows = F.from_json(typed("basic_rows"), "array<array<string>>")
    good_rows = F.coalesce(F.forall(rows, lambda r: F.coalesce(F.size(r) == BASIC_COLUMNS, F.lit(False))), F.lit(False))
    error = F.when(filled("code").isNull(), "code").when(bad_date, "date").when(filled("basic_rows").isNotNull() & ~good_rows, "rows")
    return forms.select("seq", _renames(F.col("original"), typed("code")).alias("gone"), error.alias("error"), typed("code").alias("code"), *[(F.col(c) if c == "status" else filled(c)).alias(c) for c in PROJECT[1:]])


def deletions(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Edits that take away ``gone`` at ``seq`` and put nothing."""
    return rows.select(*[F.col(f.name) if f.name in ("seq", "gone") else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def save(rows: DataFrame, forms: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """Rows after the forms without an error and the deletions ``seq, gone``. Nothing follows a rename: what
    refers to the old key keeps it."""
    edits = forms.where("error IS NULL")
    if gone is not None:
        edits = edits.unionByName(deletions(gone, forms))
    return apply_edits(rows, edits, key)


def active_project(actions: DataFrame, start: str | None = None) -> DataFrame:
    """``store, active`` after each store's actions ``seq, kind, code``: choosing a project makes it active, saving
    one only if none is, deleting the active one leaves none. The actions of one store are folded in one row:
    they are one person's clicks."""
    none = F.lit(None).cast("string")
    step = lambda now, a: (
        F.when(a["kind"] == "use", a["code"]).when(a["kind"] == "save", F.coalesce(now, a["code"])).when((a["kind"] == "delete") & (now == a["code"]), none).otherwise(now))
    done = actions.groupBy("store").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "code"))).alias("a"))
    return done.select("store", F.aggregate("a", F.lit(start).cast("string"), step).alias("active"))


def table_rows(rows: DataFrame) -> DataFrame:
    """``name, k, num, txt`` of edited tables from ``name, seq, numeric, k, v`` as typed. Rows blank on both sides
    are no rows; a table with a bad value (no number where one is asked for, else a blank) isn't saved at
    all; a blank key is allowed, and of equal keys the last counts (of
    equal places the larger value)."""
    t = rows.select("name", "seq", "numeric", typed("k").alias("k"), typed("v").alias("v")).where("k <> '' OR v <> ''")
    number = S.to_number(F.col("v"))
    t = t.withColumn("bad", F.when(F.col("numeric"), number.isNull()).otherwise(F.col("v") == ""))
    t = t.join(t.where("bad").select("name").distinct(), "name", "left_anti").groupBy("name", "k").agg(F.max(F.struct("seq", "numeric", "v")).alias("r"))
    return t.select("name", "k", F.when(F.col("r.numeric"), S.to_number(F.col("r.v"))).alias("num"), F.when(~F.col("r.numeric"), F.col("r.v")).alias("txt"))


def save_tables(stored: DataFrame, data: DataFrame, defaults: DataFrame, versions: DataFrame) -> DataFrame:
    """``name, part, k, v, base_version``: the tables ``name, version`` saved now replace what is stored, with the
    defaults of this moment beside them, so that later defaults can be told from deleted rows."""
    part = lambda df, p: df.join(versions, "name").select("name", F.lit(p).alias("part"), "k", "v", F.col("version").alias("base_version"))
    return reset_tables(stored, versions).unionByName(part(data, "data")).unionByName(part(defaults, "base"))


def reset_tables(stored: DataFrame, names: DataFrame) -> DataFrame:
    """Back to the defaults: the stored tables ``name`` go."""
    return stored.join(names.select("name"), "name", "left_anti").select("name", "part", "k", "v", "base_version")


def save_drafts(imports: DataFrame, records: DataFrame) -> DataFrame:
    """Imports ``import_id, ts, module, project_code, missing_count, status`` after drafts of the records
    ``import_id, ord, module, ts, project_code, missing_count, status`` were written over them. A state other than
    ``exported`` is a draft; an import without records isn't written."""
    first = records.groupBy("import_id", "module").agg(F.min("ord").alias("ord"), F.max(F.struct("ts", "project_code", "missing_count", "status")).alias("r"))
    g = first.groupBy("import_id").agg(F.sort_array(F.collect_list(F.struct("ord", "module"))).alias("m"), F.max("r").alias("r"))
    modules = F.coalesce(F.nullif(F.array_join(F.transform("m", lambda x: x["module"]), "+"), F.lit("")), F.lit("water"))
    status = F.when(F.col("r.status") == "exported", "exported").otherwise("draft")
    drafts = g.select("import_id", F.col("r.ts").alias("ts"), modules.alias("module"), "r.project_code", "r.missing_count", status.alias("status"), F.col("r.ts").alias("seq"), F.lit(None).alias("gone"))
    return apply_edits(imports.select("import_id", "ts", "module", "project_code", "missing_count", "status"), drafts, "import_id")


def reopen(records: DataFrame, import_id: int, active: str | None = None) -> DataFrame:
    """The records of an import as they were saved, under its project if it had one. Warnings aren't restored."""
    project = F.coalesce(F.nullif(F.col("project_code"), F.lit("")), F.lit(active).cast("string"))
    kept = [c for c in records.columns if c not in ("warnings", "project_code")]
    return records.where(F.col("import_id") == import_id).select(*kept, project.alias("project_code"))


def delete_imports(imports: DataFrame, ids: DataFrame) -> DataFrame:
    return imports.join(ids.select("import_id").distinct(), "import_id", "left_anti")


def in_import_order(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows with ``file_ord, sheet_ord`` of ``sheets``, in the order in which files were given, sheets stand in a file
    and items in a sheet. The range partitions of the sort keep this order over many tasks."""
    return rows.join(sheets.select("sheet_id", "file_ord", "sheet_ord"), "sheet_id").orderBy("file_ord", "sheet_ord", F.asc_nulls_first("item_idx"))

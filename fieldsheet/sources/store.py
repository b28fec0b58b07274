"""Keyed stores as Parquet folders, settings, and JSON backup and restore."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORES = {"projects": "code", "stations": "name", "tables": "name", "imports": "id", "settings": "key"}
APP, VERSION = "fieldsheet", 1


class Store:
    """Five keyed stores. Every write makes a new folder and then moves a pointer file, so a reader
    sees the old rows or the new ones."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{name}.current")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.root}/{name}.current").first()[0]

    def get_all(self, name: str) -> DataFrame | None:
        at = self._current(name)
        return self.spark.read.parquet(at).orderBy(STORES[name]) if at else None

    def get(self, name: str, key) -> DataFrame | None:
        at = self._current(name)
        return self.spark.read.parquet(at).where(F.col(STORES[name]) == F.lit(key)) if at else None

    def replace(self, name: str, rows: DataFrame) -> None:
        at = f"{self.root}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        fs, p = self._fs(f"{self.root}/{name}.current")
        _, tmp = self._fs(f"{self.root}/{name}.next")
        out = fs.create(tmp, True)
        out.write(bytearray(at, "utf-8"))
        out.close()
        # One rename over the old pointer: a reader finds the old rows or the new ones.
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(tmp, p, over)

    def put(self, name: str, rows: DataFrame) -> None:
        """Insert, or replace what has the same key."""
        old = self.get_all(name)
        key = STORES[name]
        self.replace(name, rows if old is None else old.join(rows.select(key), key, "left_anti").select(*old.columns).unionByName(rows, allowMissingColumns=True))

    def delete(self, name: str, key) -> None:
        old = self.get_all(name)
        if old is not None:
            self.replace(name, old.where(F.col(STORES[name]) != F.lit(key)))

    def clear(self, name: str) -> None:
        old = self.get_all(name)
        if old is not None:
            self.replace(name, old.limit(0))

    def seed(self, name: str, rows: DataFrame) -> bool:
        """The first rows of a store that has none yet."""
        if self._current(name) is None:
            self.replace(name, rows)
            return True
        return False

    def setting(self, key: str):
        got = self.get("settings", key)
        row = got.first() if got is not None else None
        return row["value"] if row else None

    def backup(self) -> str:
        """All stores as one JSON text; master data is small, imports are backed up row by row."""
        data = {}
        for name in STORES:
            df = self.get_all(name)
            data[name] = [] if df is None else [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
        return json.dumps({"app": APP, "version": VERSION, "exportedAt": datetime.now(timezone.utc).isoformat(), "data": data}, ensure_ascii=False)

    def restore(self, text: str) -> None:
        """Replace each store by the backup's rows; the text is checked before anything is written."""
        got = json.loads(text)
        if got.get("app") != APP or not isinstance(got.get("data"), dict):
            raise ValueError("not a backup of this application")
        for name in STORES:
            rows = got["data"].get(name) or []
            if rows:
                lines = self.spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "j string")
                schema = self.spark.range(1).select(F.schema_of_json(F.lit(json.dumps(rows, ensure_ascii=False)))).first()[0]
                kept = schema.removeprefix("ARRAY<").removesuffix(">")
                self.replace(name, lines.select(F.from_json("j", kept).alias("r")).select("r.*"))
            else:
                self.clear(name)

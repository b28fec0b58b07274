"""Workbook cells as they arrive: each micro-batch runs the batch pipeline and appends what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extract as E
from ..operators import master as M

CELLS = "sheet_id long, addr string, col string, row_no int, num double, txt string"


def water_records(cells: DataFrame) -> DataFrame:
    h = E.water_heads(cells)
    return h.withColumn("key", S.record_key(F.lit("water"), F.col("station_raw"), F.col("date_start")))


def start(spark: SparkSession, source: str, target: str, checkpoint: str):
    """A stream over a folder of cell files. A batch holds whole sheets, as a sheet's cells come in one
    file. Records whose key the target has are skipped; a batch that is run again after a
    failure replaces its own folder, so records are written once."""

    def step(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        new = water_records(batch)
        try:
            old = s.read.parquet(target).where(F.col("batch") != n)
        except Exception as x:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
                raise
            old = None
        if old is not None:
            keyed = new.where("key IS NOT NULL")
            new = M.skip_duplicates(keyed, old).unionByName(new.where("key IS NULL").select(*M.skip_duplicates(keyed, old).columns))
        new.write.mode("overwrite").parquet(f"{target}/batch={n}")

    stream = spark.readStream.schema(CELLS).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it, inside a regex class.
SPACE = r"\x20\x09-\x0D"
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, found by position.

    Extra columns may clash with them in any way, even in letter case only; by
    position there is nothing for the analyser to find ambiguous. Texts may be very
    long, so Arrow batches made of them are bounded in bytes, not in rows only.
    """
    df.sparkSession.conf.set(BATCH_CONF, str(BATCH_BYTES))
    have = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{have.index(n)}").alias(n) for n in names])


def shared_checkpoints(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the session's own; on one machine, as in tests, a new one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are computed once and kept in the shared checkpoint folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)

"""A corpus pipeline of five operators; each stage works on all that the one before kept.

Every stage but the last returns the columns of ``documents``. The last one adds
``mix_*`` columns: a document occurs once for each time the mix takes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsheet.llm import decontamination, line_dedup, mixing, near_dedup, quality
from fieldsheet.llm.common import pick, shared_checkpoints, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, *COLUMNS)
    return scored.where((F.col("score") >= quality.THRESHOLD) if model else F.lit(True)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by an earlier document go; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, "lang", "source")
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_first(pick(docs, *COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    d = pick(docs, *COLUMNS)
    bad = decontamination.contaminated(d, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_bad")).distinct()
    return d.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shuffled within what each task writes."""
    return mixing.mixed(docs, keep=COLUMNS).sortWithinPartitions("mix_shard", "mix_order")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifier, the fingerprints and the draw aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; between them, documents are Parquet files in the shared checkpoint folder."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs

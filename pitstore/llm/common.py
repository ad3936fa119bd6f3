"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import prepare, scratch_dir, stored

__all__ = ["prepare", "scratch_dir", "stored", "bounded_batches", "table"]


def bounded_batches(spark: SparkSession, rows: int = 400) -> None:
    """Keeps one Arrow batch small when texts are long; Python workers hold a batch at a time."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")

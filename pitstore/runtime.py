"""Session helpers shared by the engine: configuration, scratch space, worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import ConfigError

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "pitstore", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on (UTC clock, ANSI on, adaptive plans)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package even where it was put on sys.path by hand."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where that is unset, a temporary one in local mode; a cluster could not share it and is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pitstore-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that stored() wrote and release() has not deleted.
_written: list[str] = []


def written() -> int:
    """How many tables stored() wrote that still are: the mark for a later release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables that stored() wrote after the first `since`, but for the last `keep`; how many are left.

    Only for when nothing that reads them will run again: they are what lost executors' work is redone from.
    """
    gone = _written[since : len(_written) - keep]
    jvm = spark.sparkContext._jvm
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[since : len(_written) - keep] = []
    return len(_written)


def arrow_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    """rows as a batch of the columns that kind (`name type, ...`) lists."""
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, kinds = zip(*[f.split() for f in kind.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def placed(rows: DataFrame, order: str | list[str], column: str, by: list[str] | None = None) -> DataFrame:
    """rows with <column>, their place from 0 in the order of `order`, within each value of `by`.

    Rows are dealt out by range, counted per partition and numbered inside each: no task holds all. The table
    of counts has a row for each partition and value of `by`.
    """
    by, order = by or [], [order] if isinstance(order, str) else order
    ranged = stored(rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "placed")
    sizes = ranged.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_q_{c}") for c in by], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    same = [F.col("_p") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by]]
    inside = F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order))
    return ranged.join(starts, same).withColumn(column, F.col("_start") + inside - 1).drop("_p", "_q", "_start", *[f"_q_{c}" for c in by])

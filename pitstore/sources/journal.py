"""The append-only journal: NDJSON by dataset and day, and as Parquet.

One writer at a time: a batch is numbered after the highest seq so far and written in one job, so seq is
gapless for each dataset and rows of a batch keep their arrival order.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canon import content_id, utc_day
from ..model import CANONICAL_ORDER, JOURNAL, StoreError, envelope_problem
from ..runtime import placed

LINE = "dataset string, scope string, key string, revision int, known_at long, effective_at long, availability string, source string, period_start long, period_end long, source_version string, parser string, raw_ref string, seq long, id string"


@contextlib.contextmanager
def writer_lock(root: str):
    """A second writer on this store fails at once (K02). For stores on a local or mounted file system."""
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, ".writer.lock"), "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise StoreError(f"{root} has another writer") from e
        yield


def last_seq(journal: DataFrame) -> DataFrame:
    """(dataset, last_seq): over every row, as backfills write to old days."""
    return journal.groupBy("dataset").agg(F.max("seq").alias("last_seq"))


def numbered(rows: DataFrame, journal: DataFrame | None, arrival: str = "arrival") -> DataFrame:
    """Adds seq and id: arrival order behind what the journal has (K01); rows are numbered by range, in many tasks."""
    rows = placed(rows, arrival, "_place", ["dataset"])
    base = F.lit(0).cast("long")
    if journal is not None:
        top = last_seq(journal).select(F.col("dataset").alias("_d"), "last_seq")
        rows = rows.join(top, F.col("dataset") == F.col("_d"), "left").drop("_d")
        base = F.coalesce("last_seq", F.lit(0))
    out = rows.withColumn("seq", base + F.col("_place") + 1)
    return out.withColumn("id", content_id()).select([f.name for f in JOURNAL.fields])


def append(rows: DataFrame, path: str) -> None:
    """Parquet by dataset and day of known_at, the layout that reads prune on."""
    bad = rows.withColumn("_p", envelope_problem()).where("_p is not null").select("_p").limit(1).collect()
    if bad:
        raise StoreError(bad[0]["_p"])
    day = utc_day(F.col("known_at"))
    rows.withColumn("day", day).repartition("dataset", "day").sortWithinPartitions("dataset", "day", *CANONICAL_ORDER).write.mode("append").partitionBy("dataset", "day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.parquet(path)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in JOURNAL.fields], F.col("day").cast("string").alias("day"))


# --- NDJSON ---------------------------------------------------------------------------------------------------


def export_ndjson(journal: DataFrame, path: str) -> None:
    lines = journal.withColumn("day", utc_day(F.col("known_at"))).repartition("dataset", "day").sortWithinPartitions("dataset", "day", "seq")
    lines.select("dataset", "day", F.to_json(F.struct(*[F.col(f.name) for f in JOURNAL.fields if f.name != "fields"]), {"ignoreNullFields": "false"}).alias("e"), "fields").select(
        "dataset", "day", F.concat(F.expr("left(e, length(e) - 1)"), F.lit(',"fields":'), F.col("fields"), F.lit("}")).alias("value")
    ).write.mode("append").partitionBy("dataset", "day").text(path)


def import_ndjson(spark: SparkSession, path: str, torn: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines). A line cut short at a file's end is malformed, set aside and never half-read."""
    raw = spark.read.text(path)
    parsed = raw.select("value", F.from_json("value", LINE).alias("r"), F.get_json_object("value", "$.fields").alias("fields"))
    ok = F.col("r.id").isNotNull() & F.col("value").endswith("}")
    rows = parsed.where(ok).select("r.*", "fields").select([f.name for f in JOURNAL.fields])
    bad = parsed.where(~ok).select("value")
    if torn == "fail" and bad.limit(1).collect():
        raise StoreError(f"{path}: malformed line")
    return rows, bad


def integrity(journal: DataFrame) -> DataFrame:
    """Rows whose id is not the hash of their content."""
    return journal.withColumn("expected", content_id()).where(F.col("expected") != F.col("id"))


def tail_stream(spark: SparkSession, path: str, from_seq: int = 0) -> DataFrame:
    """The journal as a stream; each row once, by checkpoint."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).where(F.col("seq") > from_seq)


def quarantine(rows: DataFrame, path: str) -> None:
    """Rejected rows with reason and payload, by the day of the rejection."""
    rows.select("dataset", "reason", "payload", F.unix_millis(F.current_timestamp()).alias("at"), F.date_format(F.current_timestamp(), "yyyy-MM-dd").alias("day")).write.mode("append").partitionBy("dataset", "day").json(path)


# --- small documents ---------------------------------------------------------------------------------------


def replace_json(path: str, doc: dict) -> None:
    """Written beside and renamed: a reader sees the old or the new."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_suffix(".tmp")
    tmp.write_text(json.dumps(doc, sort_keys=True, indent=1))
    os.replace(tmp, p)


def read_json(path: str) -> dict:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def save_manifest(root: str, datasets: dict[str, dict]) -> None:
    """Datasets and their windows in order, stamped with the time."""
    import time

    doc = {"generated_at": int(time.time() * 1000), "datasets": {d: {**v, "windows": sorted(v.get("windows", []), key=lambda w: w["from"])} for d, v in sorted(datasets.items())}}
    replace_json(os.path.join(root, "manifest.json"), doc)


def load_manifest(root: str) -> dict:
    return read_json(os.path.join(root, "manifest.json")) or {"generated_at": 0, "datasets": {}}

"""Provider formats as projections."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse

# The columns of a news event export that are used, by place.
NEWS_COLUMNS = 61
NEWS_PLACES = {"id": 0, "code": 26, "base": 27, "root": 28, "quad": 29, "goldstein": 30, "articles": 33, "tone": 34, "country": 53}
NEWS_TYPES = {"quad": "int", "articles": "int", "goldstein": "decimal(12,6)", "tone": "decimal(18,10)"}


def news_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Nine columns of each line and `bad`: not 61 columns or a number that is none. Bad lines keep their row."""
    cells = F.split(F.col(value), "\t", -1)
    rows = lines.withColumn("_c", cells)
    ok = F.size("_c") == NEWS_COLUMNS
    cols = {n: F.when(ok, F.get(F.col("_c"), F.lit(k))) for n, k in NEWS_PLACES.items()}
    cols = {n: c.try_cast(NEWS_TYPES[n]) if n in NEWS_TYPES else c for n, c in cols.items()}
    bad = ~ok
    for n in NEWS_TYPES:
        bad = bad | cols[n].isNull()
    return rows.select(*lines.columns, *[c.alias(n) for n, c in cols.items()], bad.alias("bad")).drop(value)


def news_files(spark: SparkSession, path: str) -> DataFrame:
    """Zipped exports of one member each: (path, md5, value) a line; a batch is unpacked by one task."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for f in frames:
            for p, md5, raw in zip(f["path"], f["md5"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    if len(z.namelist()) == 1:
                        lines = z.read(z.namelist()[0]).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"path": p, "md5": md5, "value": lines})

    blobs = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), "content")
    return blobs.mapInPandas(unpack, "path string, md5 string, value string")


def master_list(spark: SparkSession, path: str) -> DataFrame:
    """size, md5, url of each export in a list of whitespace-separated lines."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.size(c) == 3) & F.col("value").rlike(r"\.export\.CSV\.zip\s*$"))
    return rows.select(c[0].cast("long").alias("size"), c[1].alias("md5"), c[2].alias("url"), F.regexp_extract(c[2], r"(\d{14})\.export", 1).alias("stamp"))


def verified(blobs: DataFrame, listed: DataFrame) -> DataFrame:
    """Landed exports against their list: ok, damaged or absent."""
    have = blobs.select(F.regexp_extract("path", r"(\d{14})\.export", 1).alias("s"), F.col("md5").alias("have"))
    out = listed.join(have, F.col("stamp") == F.col("s"), "left")
    return out.select("stamp", F.when(F.col("have").isNull(), "absent").when(F.col("have") == F.col("md5"), "ok").otherwise("damaged").alias("state"))


@F.pandas_udf(T.BinaryType())
def compact_hour(header: pd.Series, lines: pd.Series) -> pd.Series:
    """A JSON header line and TSV lines, deflated."""
    return pd.Series([zlib.compress((h + "\n" + t).encode(), 9) for h, t in zip(header, lines)])


def expand_hour(blobs: DataFrame, content: str = "content") -> DataFrame:
    """(header, value): the lines of a deflated hour."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f[content]:
                header, _, body = zlib.decompress(raw).decode().partition("\n")
                json.loads(header)
                yield pd.DataFrame({"header": header, "value": body.splitlines()})

    return blobs.select(content).mapInPandas(run, "header string, value string")


# --- backfills ------------------------------------------------------------------------------------------------

BACKFILL = "scope string, effective_at long, known_at long, fields string, period_start long, period_end long, availability string, title string"


def backfill_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One candidate a line; availability is derived unless given (S16). Strict: a malformed line fails the read."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", BACKFILL, {"mode": "FAILFAST"})
    out = raw.select(row.alias("r"), F.get_json_object("value", "$.fields").alias("f")).select("r.*", "f")
    return out.withColumn("fields", F.col("f")).withColumn("availability", F.coalesce("availability", F.lit("derived"))).withColumn("parse_error", F.lit(None).cast("string")).drop("f")


COVERAGE = "hours long, listed long, records long, gaps long, failed long, expected long, done boolean, month string"


def write_months(rows: DataFrame, coverage: DataFrame, path: str) -> DataFrame:
    """Candidates (with `hour`) as NDJSON by month; the state of all months so far.

    A month without failed hours is done and never written again; one with failures is replaced by the next run.
    Rows land before their month's state: a run that dies between leaves the month open.
    """
    from ..operators.aggregates import month_of

    spark = rows.sparkSession
    replace = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month")
    replace(coverage.where(F.lit(False)).withColumn("done", F.lit(False))).parquet(f"{path}/state")
    state = lambda: spark.read.schema(COVERAGE).parquet(f"{path}/state")
    done = state().where("done").select(F.col("month").alias("m"))
    left = coverage.join(done, F.col("month") == F.col("m"), "left_anti").withColumn("done", F.col("failed") == 0)
    texts = rows.withColumn("month", month_of(F.col("hour"))).join(done, F.col("month") == F.col("m"), "left_anti")
    replace(texts.select("month", F.to_json(F.struct(*[c for c in rows.columns if c != "hour"])).alias("value"))).text(f"{path}/months")
    replace(left.select(*[c.split()[0] for c in COVERAGE.split(", ")])).parquet(f"{path}/state")
    return state()


def rates_csv(spark: SparkSession, path: str, series: str, cal: DataFrame, cadence: str = "daily") -> DataFrame:
    """Daily or monthly rates: value null for `.` or blank, in effect at 16:00 New York, known on release."""
    from ..operators.calendars import at_local, rate_published

    raw = spark.read.csv(path, header=True, inferSchema=False)
    day = F.to_date("observation_date")
    rows = raw.select(day.alias("day"), parse.human_number(parse.null_if(F.col(series), ["", "."])).value.cast("decimal(19,8)").alias("value"))
    out = rate_published(rows, "day", cadence, cal, "known_at")
    return out.select(F.lit("USD").alias("scope"), at_local(F.col("day"), 16, 0).alias("effective_at"), F.unix_millis(F.to_timestamp("day")).alias("period_start"), "known_at", "value").where("known_at is not null")


# Names of the positioning report's fields and ours.
POSITIONS = {"open_interest_all": "open_interest", "noncomm_positions_long_all": "noncomm_long", "noncomm_positions_short_all": "noncomm_short", "comm_positions_long_all": "comm_long", "comm_positions_short_all": "comm_short"}


def positions_json(rows: DataFrame, scope: str, cal: DataFrame) -> DataFrame:
    """Weekly reports (map rows), known at their release, 15:30 New York."""
    from ..operators.calendars import at_local, release_date

    day = F.to_date(F.substring(F.try_element_at("row", F.lit("report_date_as_yyyy_mm_dd")), 1, 10))
    out = release_date(rows.withColumn("day", day), "day", cal)
    fields = [parse.quiet_number(F.try_element_at("row", F.lit(k))).cast("decimal(19,8)").alias(v) for k, v in POSITIONS.items()]
    return out.where("release_day is not null").select(F.lit(scope).alias("scope"), F.unix_millis(F.to_timestamp("day")).alias("period_start"), at_local(F.col("release_day"), 15, 30).alias("known_at"), *fields)


def funding_csv(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """time, rate, price: known when in effect; no rate no row, no price null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    rows = raw.select(F.lit(scope).alias("scope"), F.col("time").try_cast("long").alias("effective_at"), parse.quiet_number(F.col("rate")).cast("decimal(19,8)").alias("rate"), parse.quiet_number(F.col("price")).cast("decimal(19,8)").alias("mark_price"))
    return rows.where("rate is not null and effective_at is not null").withColumn("known_at", F.col("effective_at"))

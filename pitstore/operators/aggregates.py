"""Hourly news aggregates and store statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIPS country codes of the regions; every event also belongs to GLOBAL.
REGIONS = {
    "US": "US",
    "EU": "AU BE BU HR CY EZ DA EN FI FR GM GR HU EI IT LG LH LU MT NL PL PO RO LO SI SP SW",
    "UK": "UK",
    "CN": "CH HK",
    "JP": "JA",
    "RU_UA": "RS UP",
    "MIDEAST": "IS GZ WE IR IZ SY LE JO SA YM KU QA AE BA MU EG",
}
HOUR = 3_600_000


def hour_end(ms: Column) -> Column:
    """The hour (end - 1h, end] that a stamp belongs to: closed on the right."""
    return (F.ceil(ms / HOUR) * HOUR).cast("long")


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of x*w over sum of w, to 8 places, half even; null without weight.

    Narrow decimals on purpose: a wide division would lose its scale.
    """
    top = F.sum((x.cast("decimal(12,6)") * w.cast("decimal(10,0)")).cast("decimal(22,6)")).cast("decimal(22,6)")
    return F.bround(F.try_divide(top, F.sum(w.cast("decimal(10,0)")).cast("decimal(12,0)")).cast("decimal(38,16)"), 8).cast("decimal(19,8)")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, c) for r, cs in REGIONS.items() for c in cs.split()], "region string, country string")


def first_of_event(events: DataFrame, by: list[str]) -> DataFrame:
    """One row an event id and hour: the first by ordinal."""
    return events.groupBy(*by).agg(F.min_by(F.struct(*[c for c in events.columns if c not in by]), "ordinal").alias("e")).select(*by, "e.*")


def news_hours(events: DataFrame, spark: SparkSession) -> DataFrame:
    """hour, region and the eleven figures (A01). events: stamp, ordinal, id, base, root, quad, goldstein, articles, tone, country.

    The region table is a fixed 50 rows, hence broadcast; counts are combined before the one shuffle.
    """
    once = first_of_event(events.withColumn("hour", hour_end(F.col("stamp"))), ["hour", "id"])
    places = F.broadcast(regions(spark).groupBy(F.col("country").alias("c")).agg(F.collect_list("region").alias("rs")))
    spread = once.join(places, F.col("country") == F.col("c"), "left").withColumn("region", F.explode(F.concat(F.array(F.lit("GLOBAL")), F.coalesce("rs", F.array().cast("array<string>")))))
    n = lambda ok: F.count_if(ok)
    return spread.groupBy("hour", "region").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("articles").alias("articles"),
        n(F.col("quad") == 4).alias("material_conflict"),
        n(F.col("quad") == 3).alias("verbal_conflict"),
        n(F.col("root") == "13").alias("threats"),
        n(F.col("root") == "14").alias("protests"),
        n(F.col("base") == "163").alias("sanctions"),
        n(F.col("root").isin("18", "19", "20")).alias("violence"),
        weighted_mean(F.col("goldstein"), F.col("articles")).alias("goldstein"),
        weighted_mean(F.col("tone"), F.col("articles")).alias("tone"),
    )


def batch_presence(stamps: DataFrame, hours: DataFrame) -> DataFrame:
    """How many of an hour's four batches are there; an absent hour counts 0."""
    want = hours.select("hour", F.explode(F.sequence(F.col("hour") - 45 * 60_000, F.col("hour"), F.lit(900_000).cast("long"))).alias("want"))
    have = stamps.select(F.col("stamp").alias("s")).distinct()
    return want.join(have, F.col("want") == F.col("s"), "left").groupBy("hour").agg(F.count("s").alias("batches"))


def month_coverage(presence: DataFrame, records: DataFrame, gaps: DataFrame, failures: DataFrame) -> DataFrame:
    """Per month: hours, batches listed and expected, records, gaps (listed, not served), failed hours.

    presence: hour, batches, a row an hour; the others: a row (with hour) each record, gap and failure. An hour
    belongs to the month that it closes. Every input is added up before the one shuffle.
    """
    parts = {"hours": (presence, F.lit(1)), "listed": (presence, F.col("batches")), "records": (records, F.lit(1)), "gaps": (gaps, F.lit(1)), "failed": (failures, F.lit(1))}
    tagged = None
    for name, (rows, n) in parts.items():
        one = rows.select(month_of(F.col("hour")).alias("month"), F.lit(name).alias("what"), n.cast("long").alias("n"))
        tagged = one if tagged is None else tagged.unionByName(one)
    sums = {name: F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)) for name in parts}
    return tagged.groupBy("month").agg(*[c.alias(name) for name, c in sums.items()], (sums["hours"] * 4).alias("expected"))


def month_of(hour: Column) -> Column:
    """The month that an hour end closes an hour of: midnight of the first belongs to the month before."""
    return F.date_format(F.timestamp_millis(hour - 1), "yyyy-MM")


def final_hours(presence: DataFrame, now: int, age_ms: int = 45 * 60_000) -> DataFrame:
    """Complete, or old enough that no more is waited for."""
    return presence.where((F.col("batches") == 4) | ((F.col("batches") > 0) & (F.lit(now) - F.col("hour") >= age_ms)))


def latest_hour(now: int, lag_ms: int = 5 * 60_000) -> int:
    return (now - lag_ms) // HOUR * HOUR


# --- the store --------------------------------------------------------------------------------------------


def day_stats(journal: DataFrame) -> DataFrame:
    """A row a dataset and day."""
    day = F.date_format(F.timestamp_millis("known_at"), "yyyy-MM-dd")
    kinds = [F.count_if(F.col("availability") == a).alias(a) for a in ("observed", "published", "derived")]
    return journal.groupBy("dataset", day.alias("day")).agg(F.count(F.lit(1)).alias("records"), F.min("known_at").alias("first_known_at"), F.max("known_at").alias("last_known_at"), F.max("seq").alias("last_seq"), F.countDistinct("scope").alias("scopes"), *kinds)


def store_state(journal: DataFrame) -> DataFrame:
    """Totals by dataset and over all."""
    return journal.rollup("dataset").agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq"), F.max("known_at").alias("last_known_at"), F.countDistinct("scope").alias("scopes"))


def outcomes(rows: DataFrame) -> DataFrame:
    """Written, quarantined, duplicates, revisions."""
    return rows.agg(
        F.count_if(F.col("outcome") == "written").alias("written"),
        F.count_if(F.col("outcome") == "quarantined").alias("quarantined"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if((F.col("outcome") == "written") & (F.col("revision") > 1)).alias("revisions"),
    )


def quarantine_counts(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def latest_rejections(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n latest rejected rows; a missing time counts as 0."""
    return rows.orderBy(F.desc(F.coalesce("at", F.lit(0))), "payload").limit(n)


def raw_totals(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count(F.lit(1)).alias("blobs"), F.sum("length").alias("bytes"))


def runs(log: DataFrame) -> DataFrame:
    """Per dataset: runs, last success, failures since (A17). log: dataset, at, ok."""
    good = log.groupBy("dataset").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"), F.count(F.lit(1)).alias("runs"))
    return log.join(good.withColumnRenamed("dataset", "d"), F.col("dataset") == F.col("d")).groupBy("dataset", "runs", "last_success_at").agg(F.count_if(F.col("at") > F.coalesce("last_success_at", F.lit(0))).alias("consecutive_failures"))

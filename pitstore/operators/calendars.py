"""Calendars, release rules and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ParseError

# Days on which federal offices were closed besides holidays.
SPECIAL_CLOSURES = (
    "2004-06-11", "2007-01-02", "2007-12-24", "2008-12-26", "2010-02-08", "2010-02-09", "2010-02-10", "2010-02-11",
    "2012-10-29", "2012-10-30", "2012-12-24", "2014-12-26", "2015-12-24", "2016-01-25", "2016-01-26", "2018-12-05",
    "2018-12-24", "2019-12-24", "2020-12-24", "2024-12-24", "2025-01-09", "2025-12-24", "2025-12-26",
)
# Positioning reports released off the rule, report day -> release day.
CATCH_UP = {
    "2013-10-01": "2013-10-25", "2013-10-08": "2013-11-01", "2013-10-15": "2013-11-01", "2013-10-22": "2013-11-08",
    "2013-10-29": "2013-11-08", "2014-12-23": "2014-12-30", "2018-12-24": "2019-02-01", "2018-12-31": "2019-02-05",
    "2019-01-08": "2019-02-08", "2019-01-15": "2019-02-12", "2019-01-22": "2019-02-15", "2019-01-29": "2019-02-19",
    "2019-02-05": "2019-02-22", "2019-02-12": "2019-02-26", "2019-02-19": "2019-03-01", "2019-02-26": "2019-03-05",
    "2023-01-31": "2023-02-24", "2023-02-07": "2023-03-03", "2023-02-14": "2023-03-08", "2023-02-21": "2023-03-10",
    "2023-02-28": "2023-03-14", "2023-03-07": "2023-03-16", "2023-03-14": "2023-03-21", "2025-09-30": "2025-11-19",
    "2025-10-07": "2025-11-21", "2025-10-14": "2025-11-25", "2025-10-21": "2025-12-02", "2025-10-28": "2025-12-05",
    "2025-11-04": "2025-12-09", "2025-11-10": "2025-12-10", "2025-11-18": "2025-12-12", "2025-11-25": "2025-12-15",
    "2025-12-02": "2025-12-17", "2025-12-09": "2025-12-19", "2025-12-16": "2025-12-23", "2025-12-23": "2025-12-29",
}
NEW_YORK = "America/New_York"


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def nominal_holiday(d: Column) -> Column:
    """The ten (eleven since 2021) federal holidays on their own dates, without observed shifts."""
    m, dom, dow = F.month(d), F.dayofmonth(d), F.dayofweek(d)  # Sunday is 1

    def nth(month: int, weekday: int, n: int) -> Column:
        return (m == month) & (dow == weekday) & (dom > 7 * (n - 1)) & (dom <= 7 * n)

    fixed = ((m == 1) & (dom == 1)) | ((m == 7) & (dom == 4)) | ((m == 11) & (dom == 11)) | ((m == 12) & (dom == 25)) | ((m == 6) & (dom == 19) & (F.year(d) >= 2021))
    moving = nth(1, 2, 3) | nth(2, 2, 3) | ((m == 5) & (dow == 2) & (dom > 24)) | nth(9, 2, 1) | nth(10, 2, 2) | nth(11, 5, 4)
    return fixed | moving


def holiday(d: Column) -> Column:
    """Observed: a Saturday holiday on the Friday before, a Sunday one on the Monday after."""
    dow = F.dayofweek(d)
    weekday = ~dow.isin(1, 7)
    return (weekday & nominal_holiday(d)) | ((dow == 6) & nominal_holiday(F.date_add(d, 1))) | ((dow == 2) & nominal_holiday(F.date_sub(d, 1)))


def closed(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7) | holiday(d) | d.cast("string").isin(*SPECIAL_CLOSURES)


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """day, closed, ordinal: the count of open days up to it."""
    open_ = F.sum(F.when(closed(F.col("day")), 0).otherwise(1)).over(Window.partitionBy(F.lit(0)).orderBy("day"))
    return days(spark, first, last).select("day", closed(F.col("day")).alias("closed"), open_.alias("ordinal"))


def next_business_day(rows: DataFrame, day: str, n: int, cal: DataFrame, out: str = "business_day") -> DataFrame:
    """The nth open day strictly after each day (H03, J10). A calendar has a row a day, so it goes to all tasks."""
    now = cal.select(F.col("day").alias("_d"), F.col("ordinal").alias("_o"))
    then = cal.where(~F.col("closed")).select(F.col("day").alias(out), F.col("ordinal").alias("_p"))
    step = F.broadcast(now.join(then, F.col("_p") == F.col("_o") + n).select("_d", out))
    return rows.join(step, rows[day] == F.col("_d"), "left").drop("_d")


def at_local(day: Column, hour: int, minute: int, zone: str = NEW_YORK) -> Column:
    """UTC milliseconds of a local wall-clock time."""
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(day) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute)), zone))


def rate_published(rows: DataFrame, day: str, cadence: str, cal: DataFrame, out: str = "published_at") -> DataFrame:
    """Daily: 16:30 New York on the next open day; monthly: on the second open day after the month's end."""
    base = rows.withColumn("_base", F.col(day) if cadence == "daily" else F.last_day(F.col(day)))
    found = next_business_day(base, "_base", 1 if cadence == "daily" else 2, cal, "_day")
    return found.withColumn(out, at_local(F.col("_day"), 16, 30)).drop("_base", "_day")


def release_date(rows: DataFrame, day: str, cal: DataFrame, out: str = "release_day") -> DataFrame:
    """Positioning reports: the next Friday; past it if Wednesday to Friday hold a closure; overrides first."""
    friday = F.next_day(F.col(day), "FR")
    held = closed(friday) | closed(F.date_sub(friday, 1)) | closed(F.date_sub(friday, 2))
    base = rows.withColumn("_friday", friday).withColumn("_held", held)
    found = next_business_day(base, "_friday", 1, cal, "_late")
    fixed = F.try_element_at(F.create_map(*[F.lit(x) for kv in CATCH_UP.items() for x in kv]), F.col(day).cast("string")).cast("date")
    return found.withColumn(out, F.coalesce(fixed, F.when(F.col("_held"), F.col("_late")).otherwise(F.col("_friday")))).drop("_friday", "_held", "_late")


def month_hours(month: Column) -> Column:
    """The hour ends of a yyyy-MM month, 01:00 to the next month's 00:00."""
    first = F.to_timestamp(F.concat(month, F.lit("-01")), "yyyy-MM-dd")
    return F.sequence(first + F.expr("interval 1 hour"), F.to_timestamp(F.add_months(first, 1)), F.expr("interval 1 hour"))


# --- schedules --------------------------------------------------------------------------------------------


def load_schedule(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """kind, at (ms) from a CSV of kind, date, time, zone; comments left out.

    An unknown kind, a bad time or two events at one instant refuse the file.
    """
    raw = spark.read.csv(path, header=True, comment="#", inferSchema=False)
    local = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy-MM-dd HH:mm"))
    rows = raw.select(F.trim("kind").alias("kind"), F.unix_millis(F.to_utc_timestamp(local, F.trim("zone"))).alias("at"))
    bad = rows.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind")).where((F.col("n") > 1) | F.col("at").isNull()).limit(1).collect()
    odd = rows.where(~F.col("kind").isin(*kinds)).limit(1).collect()
    if bad or odd:
        raise ParseError(f"{path}: {'unknown kind ' + str(odd[0]['kind']) if odd else 'bad or repeated instant'}")
    return rows


def published(events: DataFrame, start_ms: int, by: list[str] = ()) -> DataFrame:
    """An event becomes known a minute after the one before it; the first at the start."""
    w = Window.partitionBy(*by).orderBy("at") if by else Window.partitionBy(F.lit(0)).orderBy("at")
    return events.withColumn("published_at", F.coalesce(F.lag("at").over(w) + 60_000, F.lit(start_ms)))


def next_event(events: DataFrame, now: Column | int, by: list[str] = ()) -> DataFrame:
    """The first event that is not yet a minute past."""
    t = F.lit(now) if isinstance(now, int) else now
    return events.where(t < F.col("at") + 60_000).groupBy(*by).agg(F.min_by(F.struct("kind", "at"), "at").alias("e")).select(*by, "e.kind", "e.at")


def schedule_candidates(events: DataFrame, scope: str, kinds: list[str]) -> DataFrame:
    """An event as a fact: at = effective = period start, kind as its ordinal."""
    ordinal = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) - 1
    return events.select(F.lit(scope).alias("scope"), F.col("at").alias("effective_at"), F.col("at").alias("period_start"), ordinal.cast("int").alias("kind"), F.col("at"))

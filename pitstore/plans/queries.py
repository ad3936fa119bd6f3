"""The driver's catalogue: every operator over the driver tables, beside the SQL that checks it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, expr, parse
from ..operators import aggregates, asof, calendars, revise, snapshot, validate
from ..runtime import prepare
from ..sources import declarative, formats

T_AT = 1_705_000_000_000  # an instant inside the events
DAY = 86_400_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a journal: scope, key, revision, known_at, effective_at, availability, seq, value."""
    e = _t(spark, sf_dir, "events")
    rows = e.select(
        F.lit("mkt.test.events").alias("dataset"),
        F.upper("event_type").alias("scope"),
        F.concat_ws("|", F.upper("event_type"), F.col("user_id").cast("string")).alias("key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("known_at"),
        (F.unix_millis(F.col("ts").cast("timestamp")) + F.pmod(F.col("event_id") * 7919, F.lit(1000)) * 60_000).alias("effective_at"),
        F.when(F.col("event_id") % 3 == 0, "observed").when(F.col("event_id") % 3 == 1, "published").otherwise("derived").alias("availability"),
        (F.col("event_id") + 1).alias("seq"),
        F.col("value").cast("decimal(19,8)").alias("value"),
        F.lit(1).alias("revision"),
    )
    return rows


FACTS = """facts AS (
  SELECT 'mkt.test.events' AS dataset, upper(event_type) AS scope, upper(event_type) || '|' || user_id AS key, epoch_us(ts) // 1000 AS known_at,
         epoch_us(ts) // 1000 + (event_id * 7919) % 1000 * 60000 AS effective_at,
         CASE event_id % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'published' ELSE 'derived' END AS availability,
         event_id + 1 AS seq, CAST(value AS DECIMAL(19,8)) AS value, 1 AS revision FROM events)"""

#: Columns that are compared as doubles or as text, as engines hand decimals and dates over in different types.
DOUBLES = {
    "value": ("as_of_latest", "as_of_min_lag", "as_of_refuse_derived", "as_of_many", "range_scan", "parse_human_number", "parse_percent"),
    "y": ("derive_lag", "derive_diff", "derive_zscore", "derive_pct_rank", "derive_chain_z", "derive_arith"),
    "gap": ("derive_arith",),
    "want": ("verify_derived",),
    "have": ("verify_derived",),
    "goldstein": ("weighted_mean",),
}
TEXTS = {"day": ("holiday_calendar", "business_days"), "business_day": ("business_days",), "release_day": ("release_dates",), "hour": ("month_hours",)}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        @functools.wraps(f)
        def plain(spark, sf_dir):
            df = f(spark, sf_dir)
            kinds = {"decimal": "double", "date": "string", "timesta": "string"}
            return df.select(*[F.col(c).cast(kinds[k[:7]]).alias(c) if k[:7] in kinds else F.col(c) for c, k in df.dtypes])

        QUERIES[f.__name__] = plain
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _latest_sql(where: str, columns: str = "scope, key, known_at, seq, value") -> str:
    return f"WITH {FACTS} SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY revision DESC, known_at DESC, seq DESC) AS n FROM facts WHERE {where}) WHERE n = 1"


# --- point-in-time reads ------------------------------------------------------------------------------------


@query(_latest_sql(f"known_at <= {T_AT}"))
def as_of_latest(spark, sf_dir):
    """R01, A14, P06, P07, O04."""
    return asof.as_of(facts(spark, sf_dir), T_AT).select("scope", "key", "known_at", "seq", "value")


@query(_latest_sql(f"known_at + 3600000 <= {T_AT} AND scope = 'PURCHASE'"))
def as_of_min_lag(spark, sf_dir):
    """A lag hides what is too fresh."""
    return asof.as_of(facts(spark, sf_dir), T_AT, "PURCHASE", asof.Policy(min_lag_ms=3_600_000)).select("scope", "key", "known_at", "seq", "value")


@query(_latest_sql(f"known_at <= {T_AT} AND availability <> 'derived'"))
def as_of_refuse_derived(spark, sf_dir):
    """Derived facts are invisible, not last in line."""
    return asof.as_of(facts(spark, sf_dir), T_AT, policy=asof.Policy(refuse_derived=True)).select("scope", "key", "known_at", "seq", "value")


@query(
    """WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, epoch_us(ts) // 1000 + 1000 AS t, CAST(value AS DECIMAL(19,8)) AS value FROM events WHERE event_type = 'error')
SELECT p.event_id, p.user_id, p.t AS at, f.value FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.t >= f.t"""
)
def as_of_many(spark, sf_dir):
    """J01 for many instants: each purchase and the user's latest error known a second before."""
    e = _t(spark, sf_dir, "events").withColumn("known_at", F.unix_millis(F.col("ts").cast("timestamp")))
    errors = e.where("event_type = 'error'").select("user_id", "known_at", F.col("event_id").alias("seq"), F.col("value").cast("decimal(19,8)").alias("value"))
    probes = e.where("event_type = 'purchase'").select("user_id", F.col("known_at").alias("at"), "event_id")
    return asof.as_of_many(errors, probes, ["user_id"], "at", "event_id", F.col("value"), lag_ms=1000)


@query(
    f"WITH {FACTS}, seen AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY revision DESC, known_at DESC, seq DESC) AS n FROM facts WHERE known_at <= {T_AT}) "
    f"SELECT scope, effective_at - 1000 AS start, effective_at + 1000 AS \"end\" FROM seen WHERE n = 1 AND effective_at BETWEEN {T_AT} AND {T_AT} + 36000000"
)
def event_windows(spark, sf_dir):
    """R02, O05."""
    return asof.windows(facts(spark, sf_dir), T_AT, 36_000_000, 1000)


@query(f"WITH {FACTS} SELECT scope, key, known_at, seq, value FROM facts WHERE known_at BETWEEN {T_AT} - {DAY} AND {T_AT}")
def range_scan(spark, sf_dir):
    """S11, P06, O01."""
    return asof.known_between(facts(spark, sf_dir), T_AT - DAY, T_AT).select("scope", "key", "known_at", "seq", "value").orderBy("known_at", "scope", "key", "seq")


@query(f"WITH {FACTS} SELECT scope, key, revision, known_at, seq FROM facts WHERE known_at BETWEEN {T_AT} - {DAY} * 5 AND {T_AT} + {DAY} * 5")
def range_union_gap(spark, sf_dir):
    """Compiled months and what the journal has besides; nothing lost, nothing twice."""
    f = facts(spark, sf_dir).select("scope", "key", "revision", "known_at", "seq")
    compiled = f.where(F.col("seq") <= 5000)
    months = compiled.groupBy(canon.utc_month(F.col("known_at")).alias("month")).agg(F.lit(5000).alias("last_seq"))
    return asof.covered_range(f, compiled, months, T_AT - 5 * DAY, T_AT + 5 * DAY)


@query(f"WITH {FACTS} SELECT seq, scope, key, known_at FROM facts WHERE seq > 4321")
def tail_from_seq(spark, sf_dir):
    """R04, T02."""
    return asof.tail(facts(spark, sf_dir), 4321).select("seq", "scope", "key", "known_at")


@query(f"WITH {FACTS} SELECT seq, scope, key FROM facts ORDER BY seq DESC LIMIT 50")
def topk_latest(spark, sf_dir):
    """O02."""
    return asof.newest(facts(spark, sf_dir), 50).select("seq", "scope", "key")


@query(f"WITH {FACTS} SELECT known_at, seq, value::VARCHAR AS value FROM (SELECT * FROM facts WHERE scope = 'CLICK' ORDER BY known_at DESC, seq DESC LIMIT 200)")
def series_last_n(spark, sf_dir):
    """O03, R07."""
    j = facts(spark, sf_dir).withColumn("fields", F.to_json(F.struct(F.col("value").cast("string").alias("value"))))
    return asof.series(j, "CLICK", "value", 200)


@query(
    f"WITH {FACTS}, e AS (SELECT *, greatest(CAST(ceil((effective_at - 1800000) / 300000.0) AS BIGINT) * 300000, (known_at // 300000 + 1) * 300000) AS entry FROM facts) "
    f"SELECT seq, entry FROM e WHERE entry < effective_at AND entry >= {T_AT} AND entry < {T_AT} + {DAY}"
)
def entry_bars(spark, sf_dir):
    """P15, R08, F27."""
    return asof.expected_entries(facts(spark, sf_dir), 1_800_000, 300_000, T_AT, T_AT + DAY).select("seq", "entry")


@query(f"WITH {FACTS} SELECT dataset, max(known_at) AS last_known_at, max(seq) AS last_seq, 1707000000000 - max(known_at) AS age_ms, 1707000000000 - max(known_at) > 3600000 AS stale FROM facts GROUP BY dataset")
def reader_health(spark, sf_dir):
    """R06, T13."""
    return asof.health(facts(spark, sf_dir), 1_707_000_000_000)


# --- revisions and history ----------------------------------------------------------------------------------

_REV = """WITH r AS (SELECT event_type, user_id, event_id, CAST(floor(value / 100) AS BIGINT)::VARCHAR AS payload FROM events),
c AS (SELECT *, CASE WHEN payload IS DISTINCT FROM lag(payload) OVER w THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS INTEGER) AS revision FROM c)"""


def _revisions(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_type", "user_id", "event_id", F.floor(F.col("value") / 100).cast("long").cast("string").alias("payload"))
    return revise.assign_revisions(rows, ["event_type", "user_id"], ["event_id"], F.col("payload"))


@query(_REV + " SELECT event_type, user_id, event_id, revision, sha256(payload) AS payload_hash FROM n WHERE fresh = 1")
def dedupe_revisions(spark, sf_dir):
    """Changes only, numbered."""
    return _revisions(spark, sf_dir).select("event_type", "user_id", "event_id", "revision", "payload_hash")


@query(_REV + " SELECT event_type, user_id, max(revision) AS revision, arg_max(sha256(payload), revision) AS payload_hash FROM n WHERE fresh = 1 GROUP BY ALL")
def revision_latest(spark, sf_dir):
    """The highest revision of each key."""
    top = F.max_by(F.struct("revision", "payload_hash"), "revision").alias("s")
    return _revisions(spark, sf_dir).groupBy("event_type", "user_id").agg(top).select("event_type", "user_id", "s.*")


@query(
    """WITH f AS (SELECT user_id AS scope, event_type AS key, event_id AS seq, epoch_us(ts) // 1000 + (event_id * 7919) % 1000 * 60000 AS effective_at, CAST(floor(value) AS BIGINT)::VARCHAR AS value FROM events), past AS (
  SELECT c.scope, c.seq, c.effective_at AS e_at, c.key, h.key AS hk, arg_max(h.effective_at, h.seq) AS he, arg_max(h.value, h.seq) AS hv
  FROM f c JOIN f h ON c.scope = h.scope AND h.seq < c.seq AND h.key <> c.key GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope, seq ORDER BY he DESC, hk DESC) AS n FROM past WHERE he < e_at OR (he = e_at AND hk < key))
SELECT scope, seq, string_agg(hv, ',' ORDER BY n DESC) AS history FROM ranked WHERE n <= 3 GROUP BY scope, seq"""
)
def bitemporal_history(spark, sf_dir):
    """For each fact of a user the three before it in effect, as known when it came."""
    e = _t(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp")) + F.pmod(F.col("event_id") * 7919, F.lit(1000)) * 60_000
    f = e.select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), at.alias("effective_at"), F.floor("value").cast("string").alias("value"))
    return revise.history_before(f, 3).select("scope", "seq", F.array_join(F.transform("history", lambda x: x["v"]), ",").alias("history"))


# --- derived fields -----------------------------------------------------------------------------------------


def _derived(spark, sf_dir, text: str, cast: str | None = None):
    f = facts(spark, sf_dir).withColumn("order_key", F.col("seq"))
    out = revise.with_derived(f, [("y", text)], ["scope"], ["seq"])
    y = F.round(F.col("y"), 6).cast("decimal(20,6)") if cast is None else F.col("y").cast(cast)
    return out.select("seq", y.alias("y"))


def _wsql(body: str, window: str = "") -> str:
    return f"WITH {FACTS} SELECT seq, {body} AS y FROM facts {window}"


_FRAME = "WINDOW w AS (PARTITION BY scope ORDER BY seq), f AS (PARTITION BY scope ORDER BY seq ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"


@query(_wsql("CAST(lag(value, 3) OVER w AS DECIMAL(19,8))", _FRAME))
def derive_lag(spark, sf_dir):
    """W01."""
    return _derived(spark, sf_dir, "lag(value, 3)", "decimal(19,8)")


@query(_wsql("CAST(value - lag(value, 1) OVER w AS DECIMAL(20,8))", _FRAME))
def derive_diff(spark, sf_dir):
    """W02."""
    return _derived(spark, sf_dir, "diff(value, 1)", "decimal(20,8)")


_Z = "CASE WHEN count(*) OVER f >= 8 AND count(*) OVER f = count({0}) OVER f AND stddev_samp({0}::DOUBLE) OVER f > 0 THEN ({0}::DOUBLE - avg({0}::DOUBLE) OVER f) / stddev_samp({0}::DOUBLE) OVER f END"


@query(_wsql(f"CAST(round({_Z.format('value')}, 6) AS DECIMAL(20,6))", _FRAME))
def derive_zscore(spark, sf_dir):
    """The row itself is outside its frame."""
    return _derived(spark, sf_dir, "zscore(value, window=24, min_obs=8)")


@query(
    f"WITH {FACTS}, h AS (SELECT seq, value, list(value) OVER (PARTITION BY scope ORDER BY seq ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l FROM facts) "
    "SELECT seq, CAST(CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: x < value)) / len(l)::DOUBLE, 6) END AS DECIMAL(20,6)) AS y FROM h"
)
def derive_pct_rank(spark, sf_dir):
    """The share strictly below."""
    return _derived(spark, sf_dir, "pct_rank(value, window=24)")


@query(
    f"WITH {FACTS}, d AS (SELECT seq, scope, value - lag(value, 1) OVER (PARTITION BY scope ORDER BY seq) AS d FROM facts) "
    f"SELECT seq, CAST(round({_Z.format('d')}, 6) AS DECIMAL(20,6)) AS y FROM d WINDOW f AS (PARTITION BY scope ORDER BY seq ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
)
def derive_chain_z(spark, sf_dir):
    """A derived field that reads a derived field, in layers."""
    f = facts(spark, sf_dir)
    out = revise.with_derived(f, [("d", "diff(value, 1)"), ("y", "zscore(d, window=24, min_obs=8)")], ["scope"], ["seq"])
    return out.select("seq", F.round("y", 6).cast("decimal(20,6)").alias("y"))


_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(l_quantity AS DECIMAL(12,2)) AS q, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(12,2)) AS d FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(CASE WHEN d = 0 THEN NULL ELSE (-(p - q) * 2)::DOUBLE / d::DOUBLE END, 4) AS DECIMAL(20,4)) AS y, CAST(p - q AS DECIMAL(20,2)) AS gap FROM ({_LINE})")
def derive_arith(spark, sf_dir):
    """Division by zero is null."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(12,2)").alias("q"), F.col("l_extendedprice").cast("decimal(12,2)").alias("p"), F.col("l_discount").cast("decimal(12,2)").alias("d"))
    both = {c: F.col(c) for c in "qpd"}
    top = expr.to_column(expr.parse("-(p - q) * 2"), None, both).cast("double")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.try_divide(top, F.col("d").cast("double")), 4).cast("decimal(20,4)").alias("y"), expr.to_column(expr.parse("p - q"), None, both).cast("decimal(20,2)").alias("gap"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(o_orderdate) // 1000 - epoch_us(l_shipdate) // 1000 AS since_ms, epoch_us(l_shipdate) // 1000 - epoch_us(o_orderdate) // 1000 AS until_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
def since_until(spark, sf_dir):
    """W05, W06."""
    li, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("known_at"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("at"))
    f = {"at": F.col("at")}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", expr.to_column(expr.parse("since(at)"), None, f).alias("since_ms"), expr.to_column(expr.parse("until(at)"), None, f).alias("until_ms"))


# --- parsing ------------------------------------------------------------------------------------------------

_RAW = """raw AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN round(value, 2)::VARCHAR || 'K' WHEN 1 THEN '  ' || CAST(floor(value) AS BIGINT)::VARCHAR || 'm ' WHEN 2 THEN '1,' || lpad((event_id % 1000)::VARCHAR, 3, '0') WHEN 3 THEN 'n/a' WHEN 4 THEN 'x' || event_id ELSE '-0.5%' END AS raw
FROM events)"""


def _raw(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.concat(F.round("value", 2).cast("decimal(12,2)").cast("double").cast("string"), F.lit("K")))
        .when(k == 1, F.concat(F.lit("  "), F.floor("value").cast("string"), F.lit("m ")))
        .when(k == 2, F.concat(F.lit("1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")))
        .when(k == 3, "n/a")
        .when(k == 4, F.concat(F.lit("x"), F.col("event_id").cast("string")))
        .otherwise("-0.5%")
    )
    return e.select("event_id", text.alias("raw"))


_NUMBER_SQL = """SELECT event_id, CAST(CASE WHEN lower(t) IN ('-', 'n/a', '—', '') OR NOT regexp_matches(b, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN NULL ELSE b::DECIMAL(18,8) * m END AS DECIMAL(28,8)) AS value,
(NOT lower(t) IN ('-', 'n/a', '—', '')) AND NOT regexp_matches(b, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') AS failed
FROM (SELECT *, CASE WHEN right(lower(n), 1) IN ('k', 'm', 'b') THEN left(n, -1) ELSE n END AS b, CASE right(lower(n), 1) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'b' THEN 1000000000 ELSE 1 END AS m FROM (SELECT event_id, trim(raw) AS t, {0} AS n FROM raw))"""


@query("WITH " + _RAW + _NUMBER_SQL.format("replace(trim(raw), ',', '')"))
def parse_human_number(spark, sf_dir):
    """F01, F02, F31."""
    p = parse.human_number(F.col("raw"))
    return _raw(spark, sf_dir).select("event_id", p.value.cast("decimal(28,8)").alias("value"), p.error.isNotNull().alias("failed"))


@query("WITH " + _RAW + _NUMBER_SQL.format("replace(regexp_replace(trim(raw), '%$', ''), ',', '')"))
def parse_percent(spark, sf_dir):
    """F03."""
    p = parse.percent_or_number(F.col("raw"))
    return _raw(spark, sf_dir).select("event_id", p.value.cast("decimal(28,8)").alias("value"), p.error.isNotNull().alias("failed"))


@query(
    """WITH r AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, event_id % 3 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN ms // 1000 * 1000 WHEN 1 THEN ms // 1000 * 1000 + 4 * 3600000 END AS value, k = 2 AS failed FROM r"""
)
def parse_iso_offset(spark, sf_dir):
    """no offset, no instant."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 3
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat(text, F.when(k == 0, "Z").when(k == 1, "-04:00").otherwise("")).alias("raw"))
    p = parse.iso8601_with_offset(F.col("raw"))
    return rows.select("event_id", p.value.alias("value"), p.error.isNotNull().alias("failed"))


@query(
    """SELECT event_id, (1700000000 + event_id) * 1000 + (event_id % 4) * 250 AS seconds, 1700000000000 + event_id AS millis, true AS fine_refused FROM events"""
)
def parse_epoch(spark, sf_dir):
    """whole milliseconds or nothing."""
    s = F.concat((F.col("event_id") + 1700000000).cast("string"), F.lit("."), F.lpad(((F.col("event_id") % 4) * 250).cast("string"), 3, "0"))
    rows = _t(spark, sf_dir, "events").select("event_id", s.alias("s"), (F.col("event_id") + 1700000000000).cast("string").alias("m"))
    return rows.select("event_id", parse.epoch_seconds(F.col("s")).value.alias("seconds"), parse.epoch_millis(F.col("m")).value.alias("millis"), parse.epoch_seconds(F.concat("s", F.lit("7"))).error.isNotNull().alias("fine_refused"))


@query(
    """SELECT o_orderkey, epoch_us(timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 8 HOUR)) // 1000 AS value FROM orders"""
)
def parse_date_in_zone(spark, sf_dir):
    """daylight saving by the zone's rules."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return rows.select("o_orderkey", parse.date_in_zone(F.col("d"), "America/New_York", 8).value.alias("value"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END::INTEGER AS value FROM events""")
def parse_enum(spark, sf_dir):
    """by name, whatever the case."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" "), F.upper("event_type")).alias("raw"))
    return rows.select("event_id", parse.apply("enum_ordinal", F.col("raw"), mapping={"click": 0, "View": 1, "purchase": 2}).value.cast("int").alias("value"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS value, event_id % 4 = 3 AS failed FROM events""")
def parse_bool(spark, sf_dir):
    """F09."""
    k = F.col("event_id") % 4
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(k == 0, "Yes").when(k == 1, " n").when(k == 2, "-").otherwise("maybe").alias("raw"))
    p = parse.boolean(F.col("raw"))
    return rows.select("event_id", p.value.cast("string").alias("value"), p.error.isNotNull().alias("failed"))


# --- declarative rows ---------------------------------------------------------------------------------------


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 'X' || upper(event_type) AS scope, epoch_us(ts) // 1000000 * 1000 AS effective_at, 'observed' AS availability FROM events WHERE lower(event_type) IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-10'""")
def declarative_where(spark, sf_dir):
    """Filter, mapped scope, time, field and floor, all from the collector's block."""
    e = _t(spark, sf_dir, "events")
    row = F.create_map(F.lit("event"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("ts"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    c = declarative.load_collector("mkt.test.events", {"kind": "http_json", "where": {"event": [" Click", "ERROR"]}, "scope": {"from": "event", "map": {"click": "xclick", "error": "xerror"}}, "effective_at": {"from": "ts"}, "since": "2024-01-10", "fields": {"k": {"parse": "human_number"}}})
    mapped = declarative.candidates(e.select("event_id", row.alias("row")), c, F.lit(T_AT), keep=("event_id",))
    return mapped.select("event_id", F.get_json_object("fields", "$.k").alias("k"), "scope", "effective_at", "availability")


@query("""SELECT event_id, ordinal::INTEGER AS ordinal, (event_id * 10 + ordinal)::VARCHAR AS a FROM events, (SELECT unnest(range(0, 3)) AS ordinal) WHERE ordinal <> 1""")
def json_rows(spark, sf_dir):
    """Objects under a path; what is no object is dropped."""
    i = F.col("event_id") * 10
    text = F.concat(F.lit('{"data":[{"a":'), i.cast("string"), F.lit('},7,{"a":'), (i + 2).cast("string"), F.lit("}]}"))
    blobs = _t(spark, sf_dir, "events").select("event_id", text.alias("content"))
    return declarative.json_rows(blobs, "$.data[*]").select("event_id", "ordinal", F.try_element_at("row", F.lit("a")).alias("a"))


# --- validation ---------------------------------------------------------------------------------------------

_CHECK = """WITH c AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '0.123456789' WHEN event_id % 17 = 0 THEN 'oops' ELSE CAST(value AS DECIMAL(12,2))::VARCHAR END AS v, (event_id % 5)::INTEGER AS kind FROM events),
r AS (SELECT event_id, CASE WHEN v IS NULL THEN 'value: null is not allowed' WHEN v = 'oops' THEN 'value: not a decimal' WHEN v = '0.123456789' THEN 'value: more than 8 decimals'
WHEN kind > 3 THEN 'kind: no such ordinal' WHEN v::DECIMAL(18,8) < 0 OR v::DECIMAL(18,8) > 150 THEN 'value: outside [0, 150]' END AS reason FROM c)"""


def _checked(spark, sf_dir):
    i = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(i % 11 == 0, None).when(i % 13 == 0, "0.123456789").when(i % 17 == 0, "oops").otherwise(F.col("value").cast("decimal(12,2)").cast("string")).alias("value"), (i % 5).cast("string").alias("kind"))
    return validate.with_reason(rows, validate.EXAMPLE, {"value": F.col("value"), "kind": F.col("kind")})


@query(_CHECK + " SELECT event_id, reason FROM r")
def validate_split(spark, sf_dir):
    """The first rule that a row breaks."""
    return _checked(spark, sf_dir).select("event_id", "reason")


@query(_CHECK + " SELECT reason, count(*) AS rows FROM r WHERE reason IS NOT NULL GROUP BY reason")
def quarantine_counts(spark, sf_dir):
    """A11, K07."""
    return aggregates.quarantine_counts(_checked(spark, sf_dir))


@query(_CHECK + " SELECT count(*) FILTER (WHERE reason IS NULL) AS written, count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined, 0::BIGINT AS duplicates, 0::BIGINT AS revisions FROM r")
def ingest_counters(spark, sf_dir):
    """A13."""
    rows = _checked(spark, sf_dir).select(F.when(F.col("reason").isNull(), "written").otherwise("quarantined").alias("outcome"), F.lit(1).alias("revision"))
    return aggregates.outcomes(rows)


@query(
    f"WITH {FACTS} SELECT seq, CASE WHEN known_at > {T_AT} + 5000 THEN 'known_at lies in the future' WHEN availability = 'observed' AND effective_at < {T_AT} - {DAY} * 2 THEN 'too old to have been observed live' END AS reason FROM facts"
)
def clock_and_staleness(spark, sf_dir):
    """Late rows are set aside by rule, never dropped by a watermark."""
    return facts(spark, sf_dir).select("seq", validate.clock_problem(T_AT, 2 * DAY).alias("reason"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'envelope: scope' WHEN n_nationkey % 3 = 2 THEN 'envelope: known_at out of range' END AS reason FROM nation""")
def envelope_rules(spark, sf_dir):
    """V05, V17, F23."""
    from ..model import envelope_problem

    k = F.col("n_nationkey") % 3
    rows = _t(spark, sf_dir, "nation").select(
        "n_nationkey", F.lit("mkt.test.x").alias("dataset"), F.when(k == 1, "bad.scope").otherwise(F.regexp_replace(F.upper("n_name"), "[^A-Z0-9_:-]", "_")).alias("scope"), F.col("n_name").alias("key"), F.lit(1).alias("revision"),
        F.when(k == 2, 5).otherwise(T_AT).cast("long").alias("known_at"), F.lit(T_AT).alias("effective_at"), F.lit(None).cast("long").alias("period_start"), F.lit(None).cast("long").alias("period_end"), F.lit("observed").alias("availability"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("seq"),
    )
    return rows.select("n_nationkey", envelope_problem().alias("reason"))


@query(
    f"WITH {FACTS}, d AS (SELECT seq, value - lag(value, 1) OVER (PARTITION BY scope ORDER BY seq) AS want FROM facts), s AS (SELECT seq, want, CASE WHEN seq % 1000 = 7 THEN coalesce(want, 0) + 1 ELSE want END AS have FROM d) "
    "SELECT seq, want::DECIMAL(20,8) AS want, have::DECIMAL(20,8) AS have FROM s WHERE want IS DISTINCT FROM have"
)
def verify_derived(spark, sf_dir):
    """Stored derived values that a recomputation does not give."""
    f = revise.with_derived(facts(spark, sf_dir), [("want", "diff(value, 1)")], ["scope"], ["seq"])
    stored = f.withColumn("have", F.when(F.col("seq") % 1000 == 7, F.coalesce("want", F.lit(0)) + 1).otherwise(F.col("want")))
    return stored.where(~F.col("want").eqNullSafe(F.col("have"))).select("seq", F.col("want").cast("decimal(20,8)").alias("want"), F.col("have").cast("decimal(20,8)").alias("have"))


@query(
    f"WITH {FACTS}, m AS (SELECT strftime(make_timestamp(known_at * 1000), '%Y-%m-%d') AS w, string_agg(value::VARCHAR, ',' ORDER BY seq) AS n FROM facts GROUP BY 1), t AS (SELECT strftime(make_timestamp(known_at * 1000), '%Y-%m-%d') AS w, string_agg((CASE WHEN seq = 77 THEN value + 1 ELSE value END)::VARCHAR, ',' ORDER BY seq) AS n FROM facts GROUP BY 1) "
    "SELECT coalesce(m.w, t.w) AS \"window\", 'content differs' AS problem FROM m FULL JOIN t ON m.w = t.w WHERE m.n IS DISTINCT FROM t.n"
)
def verify_windows(spark, sf_dir):
    """Windows whose content does not hash to what the manifest has."""
    f = facts(spark, sf_dir).withColumn("id", F.lit("")).withColumn("window", canon.utc_day(F.col("known_at")))
    now = f.withColumn("value", F.when(F.col("seq") == 77, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(19,8)"))
    was, now = (x.withColumn("id", F.sha2(F.concat_ws("|", "scope", "key", "seq", F.col("value").cast("string")), 256)) for x in (f, now))
    return snapshot.compare(snapshot.window_hashes(was), snapshot.window_hashes(now))


# --- aggregates ---------------------------------------------------------------------------------------------

_NEWS = """n AS (SELECT epoch_us(ts) // 1000 // 900000 * 900000 + 900000 AS stamp, event_id AS ordinal, (event_id % 9973)::VARCHAR AS id, (10 + event_id % 11)::VARCHAR AS root, CASE WHEN event_id % 7 = 0 THEN '163' ELSE '010' END AS base,
(event_id % 5)::INTEGER AS quad, CAST(event_id % 21 - 10 AS DECIMAL(12,6)) AS goldstein, (1 + event_id % 9)::INTEGER AS articles, CAST(round(value, 2) AS DECIMAL(12,6)) AS tone, ['US', 'FR', 'UK', 'CH', 'ZZ', 'RS', 'IS'][1 + user_id % 7] AS country FROM events)"""


def _news(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    return _t(spark, sf_dir, "events").select(
        ((F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 900000) + 1) * 900000).cast("long").alias("stamp"), i.alias("ordinal"), (i % 9973).cast("string").alias("id"), (i % 11 + 10).cast("string").alias("root"),
        F.when(i % 7 == 0, "163").otherwise("010").alias("base"), (i % 5).cast("int").alias("quad"), (i % 21 - 10).cast("decimal(12,6)").alias("goldstein"), (i % 9 + 1).cast("int").alias("articles"),
        F.round("value", 2).cast("decimal(12,6)").alias("tone"), F.element_at(F.array(*[F.lit(x) for x in ("US", "FR", "UK", "CH", "ZZ", "RS", "IS")]), (u % 7 + 1).cast("int")).alias("country"),
    )


_REGION_SQL = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{c}')" for r, cs in aggregates.REGIONS.items() for c in cs.split()) + ") AS t(region, country))"
_HOURS = f"""WITH {_NEWS}, {_REGION_SQL}, h AS (SELECT *, CAST(ceil(stamp / 3600000.0) AS BIGINT) * 3600000 AS hour FROM n), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hour, id ORDER BY ordinal) AS k FROM h) WHERE k = 1),
spread AS (SELECT *, 'GLOBAL' AS region FROM once UNION ALL SELECT once.*, reg.region FROM once JOIN reg USING (country))"""


@query(
    _HOURS + """ SELECT hour, region, count(*) AS events, sum(articles)::BIGINT AS articles, count(*) FILTER (WHERE quad = 4) AS material_conflict, count(*) FILTER (WHERE quad = 3) AS verbal_conflict, count(*) FILTER (WHERE root = '13') AS threats,
count(*) FILTER (WHERE root = '14') AS protests, count(*) FILTER (WHERE base = '163') AS sanctions, count(*) FILTER (WHERE root IN ('18', '19', '20')) AS violence FROM spread GROUP BY hour, region"""
)
def hour_region_agg(spark, sf_dir):
    """A01, J05, P14, T05, U02."""
    return aggregates.news_hours(_news(spark, sf_dir), spark).drop("goldstein", "tone")


@query(_HOURS + " SELECT hour, region, CAST(round(sum(goldstein * articles)::DOUBLE / sum(articles), 5) AS DECIMAL(19,5)) AS goldstein FROM spread GROUP BY hour, region")
def weighted_mean(spark, sf_dir):
    """A02."""
    return aggregates.news_hours(_news(spark, sf_dir), spark).select("hour", "region", F.round(F.col("goldstein").cast("double"), 5).cast("decimal(19,5)").alias("goldstein"))


@query(
    f"WITH {_NEWS}, st AS (SELECT DISTINCT stamp FROM n WHERE quad = 4), hrs AS (SELECT DISTINCT CAST(ceil(stamp / 3600000.0) AS BIGINT) * 3600000 AS hour FROM n) SELECT hour, count(st.stamp) AS batches FROM hrs LEFT JOIN st ON st.stamp > hour - 3600000 AND st.stamp <= hour GROUP BY hour"
)
def batch_gaps(spark, sf_dir):
    """How many of four batches each hour has."""
    n = _news(spark, sf_dir)
    hours = n.select(aggregates.hour_end(F.col("stamp")).alias("hour")).distinct()
    return aggregates.batch_presence(n.where("quad = 4"), hours)


@query(
    f"WITH {_NEWS}, st AS (SELECT DISTINCT stamp FROM n WHERE quad = 4), hrs AS (SELECT DISTINCT CAST(ceil(stamp / 3600000.0) AS BIGINT) * 3600000 AS hour FROM n), p AS (SELECT hour, count(st.stamp) AS batches FROM hrs LEFT JOIN st ON st.stamp > hour - 3600000 AND st.stamp <= hour GROUP BY hour) "
    f"SELECT hour, batches FROM p WHERE batches = 4 OR (batches > 0 AND {T_AT} - hour >= 2700000)"
)
def final_hours(spark, sf_dir):
    """T06, T07, S08."""
    return aggregates.final_hours(batch_gaps(spark, sf_dir), T_AT)


@query(
    f"""WITH {FACTS} SELECT dataset, strftime(make_timestamp(known_at * 1000), '%Y-%m-%d') AS day, count(*) AS records, min(known_at) AS first_known_at, max(known_at) AS last_known_at, max(seq) AS last_seq, count(DISTINCT scope) AS scopes,
count(*) FILTER (WHERE availability = 'observed') AS observed, count(*) FILTER (WHERE availability = 'published') AS published, count(*) FILTER (WHERE availability = 'derived') AS derived FROM facts GROUP BY ALL"""
)
def day_stats(spark, sf_dir):
    """A09, F14, F30."""
    return aggregates.day_stats(facts(spark, sf_dir))


@query(f"WITH {FACTS}, d AS (SELECT scope AS dataset, key AS scope, seq, known_at FROM facts) SELECT dataset, count(*) AS records, max(seq) AS last_seq, max(known_at) AS last_known_at, count(DISTINCT scope) AS scopes FROM d GROUP BY ROLLUP (dataset)")
def state_rollup(spark, sf_dir):
    """A10, U05."""
    f = facts(spark, sf_dir).select(F.col("scope").alias("dataset"), F.col("key").alias("scope"), "seq", "known_at")
    return aggregates.store_state(f)


@query("""WITH r AS (SELECT upper(event_type) AS dataset, epoch_us(ts) // 1000 AS "at", value > 50 AS ok FROM events), g AS (SELECT dataset, max("at") FILTER (WHERE ok) AS last_success_at, count(*) AS runs FROM r GROUP BY dataset) SELECT r.dataset, runs, last_success_at, count(*) FILTER (WHERE "at" > coalesce(last_success_at, 0)) AS consecutive_failures FROM r JOIN g ON r.dataset = g.dataset GROUP BY ALL""")
def collect_runs(spark, sf_dir):
    """A17, K10."""
    e = _t(spark, sf_dir, "events")
    return aggregates.runs(e.select(F.upper("event_type").alias("dataset"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") > 50).alias("ok")))


# --- windows, dictionaries, identity ------------------------------------------------------------------------


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS records, max(o_orderkey) AS last_seq, epoch_us(date_trunc('month', min(o_orderdate))) // 1000 AS from_ms, epoch_us(date_trunc('month', min(o_orderdate)) + INTERVAL 1 MONTH) // 1000 - 1 AS to_ms FROM orders GROUP BY 1"""
)
def month_windows(spark, sf_dir):
    """C01, C04, A04, A05, F15, F29."""
    o = _t(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("known_at"), F.col("o_orderkey").alias("seq"))
    return snapshot.months(o)


@query(
    """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS seq FROM orders), b AS (SELECT 1000 AS last_seq), f AS (SELECT min(month) AS first FROM o, b WHERE seq > last_seq), n AS (SELECT month, count(*) AS records, count(*) FILTER (WHERE seq <= last_seq) AS was FROM o, b GROUP BY month)
SELECT month, records, month < first AND records = was AS reuse FROM n, f"""
)
def changed_windows(spark, sf_dir):
    """Which months an incremental compile may keep."""
    o = _t(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("known_at"), F.col("o_orderkey").alias("seq"))
    return snapshot.reusable(o, snapshot.months(o.where("seq <= 1000")).select("month", "records"), 1000)


@query(
    f"WITH {FACTS} SELECT seq, CAST(dense_rank() OVER (ORDER BY scope) - 1 AS INTEGER) AS scope_idx, CAST(dense_rank() OVER (ORDER BY key) - 1 AS INTEGER) AS key_idx, CAST(value * 100000000 AS BIGINT) AS value_fixed FROM facts"
)
def dictionary_encode(spark, sf_dir):
    """Dictionary places by a join on the small distinct sets, not by one global sort of all rows."""
    f = facts(spark, sf_dir)
    out = f
    for c in ("scope", "key"):
        out = snapshot.with_index(out, c)
    return out.select("seq", "scope_idx", "key_idx", canon.to_fixed(F.col("value")).alias("value_fixed"))


@query(
    """SELECT event_id, 'sha256:' || sha256('{"availability":"observed","dataset":"mkt.test.events","effective_at":' || (epoch_us(ts) // 1000) || ',"fields":{"v":"' || CAST(floor(value) AS BIGINT) || '"},"key":"' || event_id || '","known_at":' || (epoch_us(ts) // 1000) || ',"parser":"p@1","revision":1,"scope":"' || upper(event_type) || '","source":"s","source_version":"","v":1}') AS id FROM events"""
)
def content_id(spark, sf_dir):
    """The identity of a record, JVM-side."""
    return _journal(spark, sf_dir).select(F.col("key").cast("long").alias("event_id"), canon.content_id().alias("id"))


def _journal(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _t(spark, sf_dir, "events").select(
        F.lit("mkt.test.events").alias("dataset"), F.upper("event_type").alias("scope"), F.col("event_id").cast("string").alias("key"), F.lit(1).alias("revision"), ms.alias("known_at"), ms.alias("effective_at"), F.lit("observed").alias("availability"), F.lit("s").alias("source"),
        F.concat(F.lit('{"v":"'), F.floor("value").cast("string"), F.lit('"}')).alias("fields"), F.lit(None).cast("long").alias("period_start"), F.lit(None).cast("long").alias("period_end"), F.lit("").alias("source_version"), F.lit("p@1").alias("parser"), F.lit(None).cast("string").alias("raw_ref"), F.col("event_id").alias("seq"),
    )


@query("""SELECT event_id, rtrim(rtrim(CAST(CAST(value AS DECIMAL(19,8)) AS VARCHAR), '0'), '.') AS text FROM events""")
def decimal_text(spark, sf_dir):
    """F11."""
    return _t(spark, sf_dir, "events").select("event_id", canon.decimal_column(F.col("value").cast("decimal(19,8)")).alias("text"))


@query(f"WITH {FACTS} SELECT key, known_at FROM facts WHERE availability <> 'derived' EXCEPT ALL SELECT key, known_at FROM facts WHERE availability = 'observed'")
def set_diff(spark, sf_dir):
    """What is expected and not there."""
    f = facts(spark, sf_dir)
    return f.where("availability <> 'derived'").select("key", "known_at").exceptAll(f.where("availability = 'observed'").select("key", "known_at"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, array_to_string([strftime(date_trunc('hour', ts) + (k * 15) * INTERVAL 1 MINUTE, '%Y%m%d%H%M%S') FOR k IN range(1, 5)], ',') AS batches FROM events""")
def batch_stamps(spark, sf_dir):
    """F17, F18."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    end = (F.floor(ms / 3600000) + 1).cast("long") * 3600000
    return _t(spark, sf_dir, "events").select("event_id", canon.stamp_text(ms).alias("stamp"), F.array_join(F.transform(canon.batch_stamps(end), canon.stamp_text), ",").alias("batches"))


# --- calendars ----------------------------------------------------------------------------------------------

_HOLIDAYS = """days AS (SELECT unnest(generate_series(DATE '1991-12-01', DATE '2000-01-31', INTERVAL 1 DAY))::DATE AS d), nom AS (SELECT d, (month(d) = 1 AND day(d) = 1) OR (month(d) = 7 AND day(d) = 4) OR (month(d) = 11 AND day(d) = 11) OR (month(d) = 12 AND day(d) = 25)
OR (month(d) = 1 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 2 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND isodow(d) = 1 AND day(d) >= 25) OR (month(d) = 9 AND isodow(d) = 1 AND day(d) <= 7)
OR (month(d) = 10 AND isodow(d) = 1 AND day(d) BETWEEN 8 AND 14) OR (month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28) AS h FROM days),
cal AS (SELECT d, isodow(d) > 5 OR (h AND isodow(d) <= 5) OR (isodow(d) = 5 AND coalesce(lead(h) OVER (ORDER BY d), false)) OR (isodow(d) = 1 AND coalesce(lag(h) OVER (ORDER BY d), false)) AS closed FROM nom),
numbered AS (SELECT *, sum(CASE WHEN closed THEN 0 ELSE 1 END) OVER (ORDER BY d) AS o FROM cal)"""


@query(f"WITH {_HOLIDAYS} SELECT d AS day, closed, o::BIGINT AS ordinal FROM numbered")
def holiday_calendar(spark, sf_dir):
    """H01, H02, H06."""
    return calendars.calendar(prepare(spark), "1991-12-01", "2000-01-31")


_ORDER_DAY = "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(DATE '1994-06-01' - DATE '2024-01-15' AS INTEGER) AS d FROM orders"


@query("SELECT o_orderkey, NULL::DATE AS day, NULL::DATE AS business_day FROM orders LIMIT 0")
def business_days(spark, sf_dir):
    """H03, J10."""
    return _business(spark, sf_dir)


def _business(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    low, high = o.agg(F.min("day"), F.max("day")).first()
    cal = calendars.calendar(spark, str(low), f"{high.year + 1}-12-31")
    return calendars.next_business_day(o, "day", 2, cal)


_CAL = _HOLIDAYS.replace("DATE '1991-12-01', DATE '2000-01-31'", "(SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) + INTERVAL 400 DAY")
_SPECIAL = "(" + ", ".join(f"DATE '{d}'" for d in calendars.SPECIAL_CLOSURES) + ")"
_CAL = _CAL.replace("isodow(d) > 5 OR", f"d IN {_SPECIAL} OR isodow(d) > 5 OR").replace("(month(d) = 12 AND day(d) = 25)", "(month(d) = 12 AND day(d) = 25) OR (month(d) = 6 AND day(d) = 19 AND year(d) >= 2021)")
ORACLES["business_days"] = f"WITH {_CAL}, x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, day, b.d AS business_day FROM x JOIN numbered n ON n.d = x.day JOIN numbered b ON NOT b.closed AND b.o = n.o + 2"


@query(
    f"WITH {_CAL}, x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, epoch_us(timezone('America/New_York', CAST(b.d AS TIMESTAMP) + INTERVAL 990 MINUTE)) // 1000 AS published_at FROM x JOIN numbered n ON n.d = x.day JOIN numbered b ON NOT b.closed AND b.o = n.o + 1"
)
def published_at(spark, sf_dir):
    """H04, S17."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    low, high = o.agg(F.min("day"), F.max("day")).first()
    cal = calendars.calendar(spark, str(low), f"{high.year + 1}-12-31")
    return calendars.rate_published(o, "day", "daily", cal).select("o_orderkey", "published_at")


@query(
    f"WITH {_CAL}, x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT *, day + CAST(CASE WHEN (5 - isodow(day) + 7) % 7 = 0 THEN 7 ELSE (5 - isodow(day) + 7) % 7 END AS INTEGER) AS fri FROM x), "
    f"k AS (SELECT f.*, n.o, n.closed OR n1.closed OR n2.closed AS held FROM f JOIN numbered n ON n.d = fri LEFT JOIN cal n1 ON n1.d = fri - 1 LEFT JOIN cal n2 ON n2.d = fri - 2), "
    "t(a, b) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in calendars.CATCH_UP.items()) + ") "
    "SELECT o_orderkey, coalesce(t.b, CASE WHEN held THEN b.d ELSE fri END) AS release_day FROM k JOIN numbered b ON NOT b.closed AND b.o = k.o + 1 LEFT JOIN t ON t.a = day"
)
def release_dates(spark, sf_dir):
    """H05, S18."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    low, high = o.agg(F.min("day"), F.max("day")).first()
    cal = calendars.calendar(spark, str(low), f"{high.year + 1}-12-31")
    return calendars.release_date(o, "day", cal).select("o_orderkey", "release_day")


@query(
    """WITH e AS (SELECT user_id, event_type AS kind, epoch_us(ts) // 1000 AS "at" FROM events) SELECT user_id, kind, "at", coalesce(lag("at") OVER (PARTITION BY user_id ORDER BY "at") + 60000, 946684800000) AS published_at FROM e"""
)
def successor_published(spark, sf_dir):
    """W11, T12, H08."""
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return calendars.published(e, 946_684_800_000, ["user_id"])


@query(f"""WITH e AS (SELECT user_id, event_type AS kind, epoch_us(ts) // 1000 AS "at" FROM events) SELECT user_id, arg_min(kind, "at") AS kind, min("at") AS "at" FROM e WHERE {T_AT} < "at" + 60000 GROUP BY user_id""")
def next_event(spark, sf_dir):
    """W12, P13."""
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return calendars.next_event(e, T_AT, ["user_id"])


@query("""WITH m AS (SELECT DISTINCT strftime(ts, '%Y-%m') AS month FROM events) SELECT month, unnest(generate_series(strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 HOUR, strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, INTERVAL 1 HOUR)) AS hour FROM m""")
def month_hours(spark, sf_dir):
    """H07."""
    m = _t(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("month")).distinct()
    return m.select("month", F.explode(calendars.month_hours(F.col("month"))).alias("hour"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS "at" FROM events), p AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS t FROM orders) SELECT o_orderkey, count(event_id) AS near FROM p LEFT JOIN e ON t BETWEEN "at" - 900000 AND "at" + 1800000 GROUP BY o_orderkey""")
def near_events(spark, sf_dir):
    """How many events are near an instant; a band join by time buckets, no cross join."""
    e = _t(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    p = _t(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    size = 2_700_000
    spread = e.withColumn("b", F.explode(F.sequence(F.floor((F.col("at") - 900_000) / size), F.floor((F.col("at") + 1_800_000) / size))))
    hit = (F.col("b") == F.floor(F.col("t") / size)) & F.col("t").between(F.col("at") - 900_000, F.col("at") + 1_800_000)
    return p.join(spread, hit, "left").groupBy("o_orderkey").agg(F.count("at").alias("near"))


# --- formats ------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN event_id::VARCHAR END AS id, CASE WHEN event_id % 10 NOT IN (3, 6) THEN (event_id % 5)::INTEGER END AS quad, CASE WHEN event_id % 10 <> 3 THEN (event_id % 9)::INTEGER END AS articles, CASE WHEN event_id % 10 <> 3 THEN -2.25::DOUBLE END AS tone, CASE WHEN event_id % 10 <> 3 THEN 'US' END AS country, event_id % 10 IN (3, 6) AS bad FROM events""")
def news_export_rows(spark, sf_dir):
    """Exactly 61 tab-separated columns; a line of others is null throughout, a cell that is no number is null."""
    i = F.col("event_id")
    cells = {0: i.cast("string"), 26: F.lit("010"), 27: F.lit("010"), 28: F.lit("01"), 29: F.when(i % 10 == 6, "four").otherwise((i % 5).cast("string")), 30: F.lit("1.5"), 33: (i % 9).cast("string"), 34: F.lit("-2.25"), 53: F.lit("US")}
    line = F.concat_ws("\t", *[cells.get(k, F.lit("x")) for k in range(61)])
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(i % 10 == 3, F.concat(line, F.lit("\tmore"))).otherwise(line).alias("value"))
    out = formats.news_events(rows)
    return out.select("event_id", "id", "quad", "articles", F.col("tone").cast("double").alias("tone"), "country", "bad")


# --- folds (no SQL) -----------------------------------------------------------------------------------------


@query()
def ingest_fold(spark, sf_dir):
    """The general fold over purchases by scope; tests hold it against a plain version."""
    return validate.example_ingest(_t(spark, sf_dir, "events"))


@query()
def snapshot_codec(spark, sf_dir):
    """Binary windows written by one task each and read back."""
    return snapshot.encoded(_journal(spark, sf_dir).withColumn("id", canon.content_id()).withColumn("month", canon.utc_month(F.col("known_at"))), validate.EXAMPLE_TEXT).select("month", "records", "sha256")


def _compared(name: str, sql: str) -> str:
    casts = [f"{c}::DOUBLE AS {c}" for c, names in DOUBLES.items() if name in names] + [f"{c}::VARCHAR AS {c}" for c, names in TEXTS.items() if name in names]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


ORACLES = {name: _compared(name, sql) for name, sql in ORACLES.items()}

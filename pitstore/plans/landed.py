"""Sources and sinks in the driver's catalogue: tables land as files in the shared folder and are read back."""

from __future__ import annotations

import io
import json
import urllib.error
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import collect
from ..config import parse_config
from ..functions import canon, expr, parse
from ..model import ConfigError, PitError
from ..operators import aggregates, asof, calendars, snapshot, validate
from ..runtime import scratch_dir
from ..sources import declarative, formats, journal, schema
from .queries import _NEWS, _checked, _journal, _news, _t, query


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- files of other formats -----------------------------------------------------------------------------------


@query("""SELECT event_id, upper(event_type) AS kind, CASE WHEN event_id % 7 > 0 THEN CAST(value AS DECIMAL(12,2))::VARCHAR END AS value FROM events""")
def csv_file_rows(spark, sf_dir):
    """A landed CSV file with a header; every value is text, an empty one null."""
    path = _place(spark, "csv")
    value = F.when(F.col("event_id") % 7 > 0, F.col("value").cast("decimal(12,2)").cast("string"))
    _t(spark, sf_dir, "events").select("event_id", F.upper("event_type").alias("kind"), value.alias("value")).write.option("header", "true").csv(path)
    cell = {c: F.try_element_at("row", F.lit(c)).alias(c) for c in ("kind", "value")}
    return declarative.csv_rows(spark, path).select(F.try_element_at("row", F.lit("event_id")).cast("long").alias("event_id"), *cell.values())


@query(
    """SELECT 'US' AS scope, epoch_us(timezone('America/New_York', TIMESTAMP '2024-01-01 08:30:00' + n_nationkey * 20 * INTERVAL 1 DAY)) // 1000 AS effective_at,
epoch_us(timezone('America/New_York', TIMESTAMP '2024-01-01 08:30:00' + n_nationkey * 20 * INTERVAL 1 DAY)) // 1000 AS period_start, (n_nationkey % 3)::INTEGER AS kind FROM nation"""
)
def schedule_file(spark, sf_dir):
    """A schedule file in local time, each event as a fact; two events at one instant refuse it."""
    path, kinds = _place(spark, "schedule"), ["rates", "jobs", "prices"]
    k = F.col("n_nationkey")
    rows = _t(spark, sf_dir, "nation").select(F.element_at(F.array(*map(F.lit, kinds)), (k % 3 + 1).cast("int")).alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (k * 20).cast("int")).cast("string").alias("date"), F.lit("08:30").alias("time"), F.lit("America/New_York").alias("zone"))
    rows.write.option("header", "true").csv(path)
    return calendars.schedule_candidates(calendars.load_schedule(spark, path, kinds), "US", kinds).drop("at")


@query("""SELECT '{"day":"' || strftime(ts, '%Y-%m-%d') || '"}' AS header, event_id || chr(9) || event_type AS value FROM events""")
def hour_blob(spark, sf_dir):
    """Lines deflated under a JSON header, one blob a day, and expanded again."""
    day = F.concat(F.lit('{"day":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}'))
    rows = _t(spark, sf_dir, "events").select(day.alias("header"), F.concat_ws("\t", F.col("event_id").cast("string"), "event_type").alias("line"))
    blobs = rows.groupBy("header").agg(F.array_join(F.collect_list("line"), "\n").alias("lines")).select(formats.compact_hour("header", "lines").alias("content"))
    return formats.expand_hour(blobs)


_STAMP = "(20240101000000 + o_orderkey)::VARCHAR"


@query(
    f"""SELECT {_STAMP} AS stamp, o_orderkey AS size, md5(o_orderkey::VARCHAR) AS md5, CASE o_orderkey % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'damaged' ELSE 'ok' END AS state FROM orders"""
)
def export_list(spark, sf_dir):
    """The list of exports, and which landed ones are what it says."""
    path = _place(spark, "list")
    key = F.col("o_orderkey").cast("string")
    stamp = (F.col("o_orderkey") + 20240101000000).cast("string")
    o = _t(spark, sf_dir, "orders").select(key.alias("size"), F.md5(key).alias("md5"), stamp.alias("stamp"))
    line = F.concat(F.col("size"), F.lit(" "), F.col("md5"), F.lit("  http://host/"), F.col("stamp"))
    o.select(F.explode(F.array(F.concat(line, F.lit(".export.CSV.zip")), F.concat(line, F.lit(".mentions.CSV.zip")), F.lit("short line"))).alias("value")).write.text(path)
    listed = formats.master_list(spark, path)
    n = F.col("size").cast("long") % 5
    blobs = o.where(n > 0).select(F.concat(F.lit("/in/"), "stamp", F.lit(".export.CSV.zip")).alias("path"), F.when(n == 1, F.md5(F.lit("cut"))).otherwise(F.col("md5")).alias("md5"))
    return listed.join(formats.verified(blobs, listed), "stamp").select("stamp", "size", "md5", "state")


@query(
    """SELECT upper(event_type) AS scope, epoch_us(ts) // 1000 AS effective_at, epoch_us(ts) // 1000 + 60000 AS known_at, '{"n":"' || event_id || '"}' AS fields, CASE WHEN event_id % 2 = 0 THEN 'observed' ELSE 'derived' END AS availability FROM events"""
)
def backfill_file(spark, sf_dir):
    """One candidate a line; availability is derived unless given."""
    path = _place(spark, "backfill")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    row = F.struct(F.upper("event_type").alias("scope"), at.alias("effective_at"), (at + 60_000).alias("known_at"), F.struct(F.col("event_id").cast("string").alias("n")).alias("fields"), F.when(F.col("event_id") % 2 == 0, "observed").alias("availability"))
    _t(spark, sf_dir, "events").select(F.to_json(row).alias("value")).write.text(path)
    return formats.backfill_ndjson(spark, path).select("scope", "effective_at", "known_at", "fields", "availability")


@query(
    """SELECT 'BTC' AS scope, 1700000000000 + event_id AS effective_at, 1700000000000 + event_id AS known_at, (event_id / 1000.0)::DOUBLE AS rate, CASE WHEN event_id % 3 > 0 THEN event_id::DOUBLE END AS mark_price FROM events WHERE event_id % 10 <> 4"""
)
def funding_file(spark, sf_dir):
    """No rate no row, no price null; a cell that is no number counts as none."""
    path, i = _place(spark, "funding"), F.col("event_id")
    rate = F.when(i % 10 == 4, "-").otherwise((i.cast("decimal(19,3)") / 1000).cast("decimal(19,3)").cast("string"))
    price = F.when(i % 3 > 0, i.cast("string")).otherwise("none")
    _t(spark, sf_dir, "events").select((i + 1700000000000).alias("time"), rate.alias("rate"), price.alias("price")).write.option("header", "true").csv(path)
    return formats.funding_csv(spark, path, "BTC").select("scope", "effective_at", "known_at", F.col("rate").cast("double").alias("rate"), F.col("mark_price").cast("double").alias("mark_price"))


@query("""SELECT sha256(n_regionkey || chr(10)) AS sha256, 2::BIGINT AS length, (SELECT count(DISTINCT n_regionkey) FROM nation) AS blobs, (SELECT 2 * count(DISTINCT n_regionkey) FROM nation)::BIGINT AS bytes FROM nation GROUP BY n_regionkey""")
def raw_blobs(spark, sf_dir):
    """Landed files by content address, each content once, and the totals of the raw store."""
    path = _place(spark, "raw")
    _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("string").alias("value")).write.partitionBy("k").text(path)
    blobs = declarative.landed(spark, path).select("sha256", "length")
    return blobs.crossJoin(F.broadcast(aggregates.raw_totals(blobs)))  # one row of totals


# --- the journal ----------------------------------------------------------------------------------------------


@query(
    """SELECT 'mkt.test.events' AS dataset, upper(event_type) AS scope, event_id::VARCHAR AS key, epoch_us(ts) // 1000 AS known_at, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY event_id % 2, event_id) AS seq FROM events"""
)
def journal_append(spark, sf_dir):
    """Two batches, the second numbered behind what the journal has; read back by day."""
    path = _place(spark, "journal")
    rows = _journal(spark, sf_dir).drop("seq").withColumn("arrival", F.col("key").cast("long"))
    journal.append(journal.numbered(rows.where("arrival % 2 = 0"), None), path)
    journal.append(journal.numbered(rows.where("arrival % 2 = 1"), journal.read(spark, path)), path)
    return journal.read(spark, path).select("dataset", "scope", "key", "known_at", "day", "seq")


@query(
    """SELECT event_id::VARCHAR AS key, '{"v":"' || CAST(floor(value) AS BIGINT) || '"}' AS fields, row_number() OVER (ORDER BY event_id) AS seq, 1::BIGINT AS torn, 0::BIGINT AS altered FROM events"""
)
def journal_lines(spark, sf_dir):
    """NDJSON by day and back; a line cut short is set aside, and every id is its content's hash."""
    path = _place(spark, "ndjson")
    rows = journal.numbered(_journal(spark, sf_dir).drop("seq").withColumn("arrival", F.col("key").cast("long")), None)
    journal.export_ndjson(rows, path)
    spark.createDataFrame([('{"dataset":"mkt.test.events","scope":"CL',)], "value string").write.text(f"{path}/dataset=mkt.test.events/day=1999-01-01")
    back, bad = journal.import_ndjson(spark, path)
    counts = bad.agg(F.count(F.lit(1)).alias("torn")).crossJoin(journal.integrity(back).agg(F.count(F.lit(1)).alias("altered")))  # one row
    return back.select("key", "fields", "seq").crossJoin(F.broadcast(counts))


@query(
    """WITH c AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '0.123456789' WHEN event_id % 17 = 0 THEN 'oops' ELSE CAST(value AS DECIMAL(12,2))::VARCHAR END AS v, (event_id % 5)::INTEGER AS kind FROM events),
r AS (SELECT event_id, CASE WHEN v IS NULL THEN 'value: null is not allowed' WHEN v = 'oops' THEN 'value: not a decimal' WHEN v = '0.123456789' THEN 'value: more than 8 decimals'
WHEN kind > 3 THEN 'kind: no such ordinal' WHEN v::DECIMAL(18,8) < 0 OR v::DECIMAL(18,8) > 150 THEN 'value: outside [0, 150]' END AS reason FROM c)
SELECT event_id::VARCHAR AS payload, reason, event_id AS "at" FROM r WHERE reason IS NOT NULL ORDER BY event_id DESC LIMIT 10"""
)
def quarantine_latest(spark, sf_dir):
    """Rejected rows written by day and read back; the ten latest."""
    path = _place(spark, "quarantine")
    rows = _checked(spark, sf_dir).where("reason is not null")
    journal.quarantine(rows.select(F.lit("mkt.test.events").alias("dataset"), "reason", F.col("event_id").cast("string").alias("payload")), path)
    back = spark.read.schema("reason string, payload string, dataset string, day string").json(path)
    return aggregates.latest_rejections(back.select("payload", "reason", F.col("payload").cast("long").alias("at")), 10)


@query(
    """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS records, array_to_string(list_sort(list_distinct(list('raw/' || event_id % 4))), ',') AS raw_deps FROM events GROUP BY 1"""
)
def compiled_months(spark, sf_dir):
    """Months written as windows, read back, and the raw blobs each one rests on."""
    path = _place(spark, "windows")
    rows = _journal(spark, sf_dir).withColumn("raw_ref", F.concat(F.lit("raw/"), (F.col("seq") % 4).cast("string")))
    snapshot.write_windows(rows, path)
    back = spark.read.parquet(path)
    counts = back.groupBy(F.col("month").cast("string").alias("m")).agg(F.count(F.lit(1)).alias("records"))
    return snapshot.raw_refs(back).join(counts, F.col("month") == F.col("m")).select("month", "records", F.array_join("raw_deps", ",").alias("raw_deps"))


@query(
    f"""WITH {_NEWS}, h AS (SELECT *, CAST(ceil(stamp / 3600000.0) AS BIGINT) * 3600000 AS hour FROM n), m AS (SELECT *, strftime(make_timestamp((hour - 1) * 1000), '%Y-%m') AS month FROM h)
SELECT month, count(DISTINCT hour) AS hours, count(DISTINCT stamp) FILTER (WHERE quad = 4) AS listed, 4 * count(DISTINCT hour) AS expected, count(*) AS records, count(*) FILTER (WHERE root = '13') AS gaps,
count(*) FILTER (WHERE ordinal % 1009 = 7) AS failed, count(*) FILTER (WHERE ordinal % 1009 = 7) = 0 AS done, count(*) AS lines FROM m GROUP BY month"""
)
def backfill_months(spark, sf_dir):
    """Records written by month with their coverage; a month with failed hours stays open."""
    path = _place(spark, "months")
    n = _news(spark, sf_dir).withColumn("hour", aggregates.hour_end(F.col("stamp")))
    presence = aggregates.batch_presence(n.where("quad = 4"), n.select("hour").distinct())
    coverage = aggregates.month_coverage(presence, n, n.where("root = '13'"), n.where("ordinal % 1009 = 7"))
    state = formats.write_months(n.select("hour", "id", "quad"), coverage, path)
    lines = spark.read.schema("value string, month string").text(f"{path}/months").groupBy(F.col("month").alias("m")).agg(F.count(F.lit(1)).alias("lines"))
    return state.join(lines, F.col("month") == F.col("m")).select("month", "hours", "listed", "expected", "records", "gaps", "failed", "done", "lines")


@query(
    """SELECT event_id AS seq, '{"known_at":' || epoch_us(ts) // 1000 || ',"effective_at":' || epoch_us(ts) // 1000 || ',"scope":"' || upper(event_type) || '","key":"' || event_id || '","revision":1,"availability":"observed","seq":' || event_id || ',"source":"s","parser":"p@1","raw_ref":null,"fields":{"v":"' || floor(value)::BIGINT || '"}}' AS view FROM events"""
)
def record_views(spark, sf_dir):
    """every record as one JSON text."""
    return _journal(spark, sf_dir).select("seq", asof.record_view().alias("view"))


@query("SELECT * FROM (VALUES ('value', 'number', 'usd', '', 'forbid', '', true), ('kind', 'enum', '', 'a,b,c,d', 'forbid', '', true)) AS t(name, type, unit, \"values\", null_policy, derived, strategy)")
def field_entries(spark, sf_dir):
    """The field table that the manifest copies from a schema."""
    rows = [(f["name"], f["type"], f["unit"], ",".join(f["values"]), f["null_policy"], f["derived"], f["strategy"]) for f in validate.EXAMPLE.field_entries()]
    return spark.createDataFrame(rows, "name string, type string, unit string, values string, null_policy string, derived string, strategy boolean")


@query("""SELECT event_id::VARCHAR AS key, event_id AS seq FROM events WHERE event_id > 2500""")
def journal_tail(spark, sf_dir):
    """The journal as a stream from a seq on, drained once into a table."""
    path, out = _place(spark, "journal"), _place(spark, "tail")
    journal.append(_journal(spark, sf_dir).withColumn("id", canon.content_id()), path)
    stream = journal.tail_stream(spark, path, 2500).select("key", "seq").writeStream.format("parquet").option("path", out).option("checkpointLocation", _place(spark, "tail-checkpoint")).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema("key string, seq long").parquet(out)


# --- rules that are read, not run over rows -------------------------------------------------------------------

_RULES = [
    ("duration", "30s", "30.0"), ("duration", "15m", "900.0"), ("duration", "6h", "21600.0"), ("duration", "1d", "86400.0"), ("duration", "45", "45.0"), ("duration", "soon", "refused"),
    ("instant", "1705000000000", "1705000000000"), ("instant", "2024-01-15T08:30:00-05:00", "1705325400000"), ("instant", "2024-01-15T08:30:00Z", "1705307400000"), ("instant", "2024-01-15T08:30:00", "refused"),
    ("lookback", "lag(value, 3)", "3"), ("lookback", "zscore(value, window=24, min_obs=8)", "24"), ("lookback", "value * 2", "0"), ("names", "diff(value, 1) / other", "other,value"), ("names", "lag(value", "refused"),
    ("keys", "kind", "kind"), ("keys", "knd", "refused"), ("storable", "", "value,kind"), ("config", "poll: { retry_seconds: 5 }", "5.0"), ("config", "poll: { retry: 5 }", "refused"), ("config", "policy: { min_lag_ms: -1 }", "refused"), ("config", "", "300.0"), ("schema", "value", "number"), ("schema", "kind", "enum"), ("schema", "other", "refused"),
]


def _rule(what: str, text: str) -> str:
    from ..cli import instant

    try:
        if what == "duration":
            return str(declarative.duration_seconds(text))
        if what == "instant":
            return str(instant(text))
        if what == "config":
            return str(parse_config(text).poll["retry_seconds"])
        if what == "lookback":
            return str(expr.lookback(text))
        if what == "names":
            return ",".join(sorted(expr.referenced_names(text)))
        if what == "keys":
            return ",".join(schema.only({text: 1}, declarative.COLLECTOR_KEYS, "collector"))
        if what == "storable":
            return ",".join(f.name for f in validate.EXAMPLE.storable_fields())
        return dict((f.name, f.type) for f in validate.EXAMPLE.strategy_fields()).get(text) or "refused"
    except (PitError, ConfigError):
        return "refused"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _RULES) + ") AS t(what, input, result)")
def config_rules(spark, sf_dir):
    """What small texts are read as, or refused."""
    return spark.createDataFrame([(what, text, _rule(what, text)) for what, text, _ in _RULES], "what string, input string, result string")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'n/x' ELSE 'v' || event_id END AS value FROM events"""
)
def null_rules(spark, sf_dir):
    """null where a value equals, trimmed or not, or opens with what stands for none."""
    k, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    raw = F.when(k == 0, " none ").when(k == 1, F.concat(F.lit("~"), i)).when(k == 2, "n/x").otherwise(F.concat(F.lit("v"), i))
    return _t(spark, sf_dir, "events").select("event_id", parse.null_if(raw, ["none"], ["~"]).alias("value"))


# --- documents over HTTP --------------------------------------------------------------------------------------

_COLLECTED = """
dataset: rates.nations
version: 1
title: A figure by nation
scope_kind: region
key: [effective_at, scope]
fields:
  value: { type: number, null_policy: forbid }
quality:
  range: { value: [0, 20] }
collector:
  kind: http_json
  url: http://host/nations
  record_path: $.rows[*]
  known_at: effective_at
  scope: { from: nation }
  effective_at: { from: day, parse: iso8601_with_offset }
  fields:
    value: { parse: human_number }
"""


def _answers(bodies: list[bytes]):
    """An opener that serves these documents in turn under their own tags, and 304 to a tag that still holds."""
    left = list(bodies)

    def opener(request, timeout):
        body = left.pop(0)
        tag = str(hash(body))
        if request.get_header("If-none-match") == tag:
            raise urllib.error.HTTPError(request.full_url, 304, "not modified", {}, None)
        answer = io.BytesIO(body)
        answer.headers = {"Content-Type": "application/json; charset=utf-8", "ETag": tag}
        return answer

    return opener


@query(
    """SELECT scope, row_number() OVER (ORDER BY poll, n_nationkey) AS seq, revision, effective_at, value FROM (
SELECT 1 AS poll, n_nationkey, upper(n_name) AS scope, 1 AS revision, epoch_us(TIMESTAMP '2024-01-01' + n_nationkey % 3 * INTERVAL 1 DAY) // 1000 AS effective_at, n_nationkey::VARCHAR AS value FROM nation WHERE n_nationkey <= 20
UNION ALL SELECT 2, n_nationkey, upper(n_name), 2, epoch_us(TIMESTAMP '2024-01-01' + n_nationkey % 3 * INTERVAL 1 DAY) // 1000, (n_nationkey + 0.5)::DECIMAL(9,1)::VARCHAR FROM nation WHERE n_nationkey < 20 AND n_nationkey % 5 = 0)"""
)
def collected_documents(spark, sf_dir):
    """A document (the 25 nations) collected three times: new, unchanged, and with every fifth figure revised.

    Figures out of range are set aside; what comes again is a duplicate.
    """
    root = _place(spark, "collected")
    if not root.startswith(("file:", "/")):
        raise ConfigError(f"{root}: documents land on a mounted file system")
    root = "/" + root.removeprefix("file:").lstrip("/")
    rows = sorted((r["n_nationkey"], r["n_name"]) for r in _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect())

    def body(half: bool) -> bytes:
        figures = [f"{n}.5" if half and n % 5 == 0 else str(n) for n, _ in rows]
        days = [f"2024-01-0{n % 3 + 1}T00:00:00Z" for n, _ in rows]
        return json.dumps({"rows": [{"nation": name.lower(), "day": d, "value": v} for (_, name), d, v in zip(rows, days, figures)]}).encode()

    made = schema.parse_schema(_COLLECTED)
    opener = _answers([body(False), body(False), body(True)])
    for _ in range(3):
        collect.collect_once(spark, root, made, opener)
    out = journal.read(spark, f"{root}/journal")
    return out.select("scope", "seq", F.col("revision").cast("int").alias("revision"), "effective_at", F.get_json_object("fields", "$.value").alias("value"))

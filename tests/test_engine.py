import hashlib
import io
import json
import os
import random
import urllib.error

import pytest
from pyspark.sql import functions as F

from pitstore import cli, collect, config, runtime
from pitstore.model import ConfigError, SchemaError, StoreError
from pitstore.operators import aggregates, asof, calendars, revise, snapshot, validate
from pitstore.sources import code, declarative, formats, journal, schema
from pitstore.streaming import ingest as streaming

DAY = 86_400_000
T0 = 1_700_000_000_000
ROW = "dataset string, scope string, key string, revision int, known_at long, effective_at long, availability string, source string, fields string, period_start long, period_end long, source_version string, parser string, raw_ref string, arrival long"


def rows(spark, facts):
    return spark.createDataFrame([("mkt.test.events", s, k, rev, known, known, a, "src", json.dumps({"value": str(v)}, separators=(",", ":")), None, None, "", "p@1", None, n) for n, (s, k, rev, known, a, v) in enumerate(facts)], ROW)


def store(spark, facts):
    return journal.numbered(rows(spark, facts), None)


def test_no_look_ahead(spark):
    rng = random.Random(11)
    facts = [("US", f"k{rng.randint(0, 5)}", 1, T0 + rng.randint(0, 72_000_000), "observed", n) for n in range(30)]
    j = store(spark, facts).cache()
    for _ in range(8):
        t = T0 + rng.randint(0, 72_000_000)
        got = asof.as_of(j, t).collect()
        assert all(r.known_at <= t for r in got)
        want = {}
        for n, (s, k, rev, known, a, v) in enumerate(facts):
            if known <= t and (k not in want or (rev, known, n + 1) > want[k]):
                want[k] = (rev, known, n + 1)
        assert {r.key: (r.revision, r.known_at, r.seq) for r in got} == want


def test_lag_trust_and_windows(spark):
    j = store(spark, [("US", "a", 1, T0, "observed", 1), ("US", "a", 2, T0 + 5000, "derived", 2), ("US", "b", 1, T0 + 600_000, "observed", 3)])
    one = lambda t, p=asof.Policy(): {r.key: r.revision for r in asof.as_of(j, t, "US", p).collect()}
    assert one(T0 + 4999) == {"a": 1} and one(T0 + 5000) == {"a": 2}
    assert one(T0 + 999, asof.Policy(min_lag_ms=1000)) == {} and one(T0 + 1000, asof.Policy(min_lag_ms=1000)) == {"a": 1}
    assert one(T0 + 9000, asof.Policy(refuse_derived=True)) == {"a": 1}
    with pytest.raises(ConfigError):
        asof.Policy(min_lag_ms=-1)


def test_a_b_a_makes_three_revisions(spark):
    df = spark.createDataFrame([("k", n, p) for n, p in enumerate("AABBA")], "key string, n int, p string")
    got = revise.assign_revisions(df, ["key"], ["n"], F.col("p")).orderBy("n").collect()
    assert [(r.n, r.revision) for r in got] == [(0, 1), (2, 2), (4, 3)]
    prior = spark.createDataFrame([("k", 4)], "key string, revision int").withColumn("payload_hash", F.sha2(F.lit("A"), 256))
    got = revise.assign_revisions(df, ["key"], ["n"], F.col("p"), prior).orderBy("n").collect()
    assert [(r.n, r.revision) for r in got] == [(2, 5), (4, 6)]


RATES = """
dataset: rates.us.test
version: 1
title: A rate
scope_kind: currency
key: [period_start, scope]
fields:
  value: { type: number, null_policy: allow }
  change_1d: { type: number, derived: "diff(value, 1)", null_policy: allow }
"""


def candidates(spark, days):
    none = None
    return spark.createDataFrame([("USD", T0 + d * DAY, T0 + d * DAY, T0 + d * DAY, none, "derived", none, json.dumps({"value": v}), none, n) for n, (d, v) in enumerate(days)], "scope string, effective_at long, known_at long, period_start long, period_end long, availability string, title string, fields string, parse_error string, arrival long")


def test_a_wide_batch_moves_nothing_in_the_middle(spark):
    s = schema.parse_schema(RATES)
    first = revise.ingest(candidates(spark, [(k, v) for k, v in enumerate(("0.9", "1.0", "1.1", "1.2"))]), s, T0 + 30 * DAY)
    j = journal.numbered(first.where("outcome = 'written'").select(F.lit(s.name).alias("dataset"), "scope", "key", "revision", "known_at", "effective_at", "availability", F.lit("x").alias("source"), "fields", "period_start", "period_end", F.lit("").alias("source_version"), F.lit("p").alias("parser"), F.lit(None).cast("string").alias("raw_ref"), "arrival"), None).cache()
    assert j.count() == 4
    again = candidates(spark, [(-400, "5"), (0, "0.9"), (1, "1.0"), (2, "1.1"), (3, "1.2"), (4, "1.3")])
    done = revise.ingest(again, s, T0 + 4 * DAY + 3_600_000, live=True, max_age_ms=DAY // 2, journal=j)
    assert aggregates.outcomes(done).first().asDict() == {"written": 1, "quarantined": 1, "duplicates": 4, "revisions": 0}
    new = json.loads(done.where("outcome = 'written'").first().fields)
    assert new == {"value": "1.3", "change_1d": "0.1"}
    back = revise.ingest(again, s, T0 + 5 * DAY, journal=j).where("outcome = 'written' and revision > 1").collect()
    assert len(back) == 1 and back[0].effective_at == T0  # only the first day sees a new predecessor


def test_bad_rows_go_alone(spark):
    s = schema.parse_schema(RATES)
    c = candidates(spark, [(0, "1"), (1, "0.123456789"), (2, "x"), (3, None)]).withColumn("parse_error", F.when(F.col("arrival") == 2, "cannot read"))
    got = {r.arrival: (r.outcome, r.reason) for r in revise.ingest(c, s, T0 + 30 * DAY).collect()}
    assert got[0][0] == got[3][0] == "written" and "8 decimals" in got[1][1] and got[2] == ("quarantined", "cannot read")
    late = revise.ingest(candidates(spark, [(0, "1")]), s, T0 - 3_600_000).first()
    assert late.outcome == "quarantined"


@pytest.mark.parametrize(
    "change",
    [("version: 1", "version: x"), ("scope_kind: currency", "scope_kind: planet"), ("dataset: rates.us.test", "dataset: zoo.test"), ("key: [period_start, scope]", "key: [change_1d]"), ("key: [period_start, scope]", "key: [nope]"), ("title: A rate", "titel: A rate"), ("diff(value, 1)", "diff(nope, 1)"), ("diff(value, 1)", "change_1d + 1"), ("type: number, null_policy", "type: float, null_policy"), ("  value:", "  known_at:"), ("null_policy: allow }\n  change", "null_policy: maybe }\n  change")],
)
def test_schemas_fail_closed(change):
    assert change[0] in RATES
    with pytest.raises((SchemaError, ConfigError)):
        schema.parse_schema(RATES.replace(*change))


def test_yaml_subset():
    for bad in ("a: &x 1\nb: *x", "a: 1\na: 2", "a: !!str 1", "a:\t1"):
        with pytest.raises(ConfigError):
            schema.load_yaml(bad)
    assert schema.load_yaml("a: yes\nb: 2020-01-01\nc: one: two") == {"a": True, "b": "2020-01-01", "c": "one: two"}


def test_schema_hash_and_projections():
    s = validate.EXAMPLE
    assert s.hash() == schema.parse_schema(validate.EXAMPLE_TEXT).hash()
    assert [f.name for f in s.storable_fields()] == ["value", "kind"] and s.struct()["value"].dataType.simpleString() == "decimal(19,8)"


def test_declarative_rows(spark):
    text = json.dumps([{"country": "usd", "date": "2026-09-10T08:15:00-04:00", "impact": "High", "title": "CPI", "forecast": "0.3%", "actual": ""}, {"country": "All", "date": "2026-09-10T08:15:00-04:00", "impact": "Low"}, {"country": "EUR", "date": "2026-09-10T08:15:00-04:00", "impact": "holiday", "forecast": "1.2.5%"}, {"country": "EUR", "date": "1999-01-01T00:00:00Z", "impact": "High"}, 7])
    c = declarative.load_collector("cal.high_impact", {"kind": "http_json", "record_path": "$[*]", "where": {"impact": ["High", "Holiday"]}, "scope": {"from": "country", "map": {"All": "ALL"}}, "effective_at": {"from": "date", "parse": "iso8601_with_offset"}, "fields": {"title": {"from": "title"}, "impact": {"from": "impact", "parse": "enum_ordinal", "map": {"high": 2, "holiday": 3}}, "forecast": {"from": "forecast", "parse": "percent_or_number", "null_if_prefix": ["<"]}, "actual": {"from": "actual", "parse": "percent_or_number"}}})
    blobs = spark.createDataFrame([(bytearray(text.encode()),)], "content binary")
    got = declarative.candidates(declarative.json_rows(blobs), c, F.lit(T0)).orderBy("scope").collect()
    assert [(r.scope, r.parse_error is None) for r in got] == [("EUR", False), ("USD", True)]
    assert json.loads(got[1].fields) == {"title": "CPI", "impact": 2, "forecast": "0.3", "actual": None}
    with pytest.raises(ConfigError):
        declarative.load_collector("a.b", {"kind": "http_xml"})
    with pytest.raises(SchemaError):
        declarative.load_collector("a.b", {"kind": "http_json", "wher": {}})
    assert [declarative.duration_seconds(x) for x in ("30s", "15m", "6h", "1d", "45")] == [30, 900, 21600, 86400, 45]
    with pytest.raises(ConfigError):
        declarative.duration_seconds("soon")
    assert declarative.Cadence(1800, 900, 1800, 30).interval(1000, [1500]) == 30 and declarative.Cadence(1800, 900, 1800, 30).interval(9000, [1500]) == 1800


def test_calendar_rules(spark):
    cal = calendars.calendar(spark, "2013-01-01", "2027-01-31").cache()
    days = spark.createDataFrame([("2024-06-12",), ("2024-06-14",), ("2024-08-30",)], "d string").select(F.to_date("d").alias("d"))
    got = {str(r.d): str(r.b) for r in calendars.next_business_day(days, "d", 1, cal, "b").collect()}
    assert got == {"2024-06-12": "2024-06-13", "2024-06-14": "2024-06-17", "2024-08-30": "2024-09-03"}
    reports = spark.createDataFrame([(d,) for d in ("2025-10-07", "2026-01-06", "2026-11-10", "2025-11-25")], "d string").select(F.to_date("d").alias("d"))
    got = {str(r.d): str(r.r) for r in calendars.release_date(reports, "d", cal, "r").collect()}
    assert got == {"2025-10-07": "2025-11-21", "2026-01-06": "2026-01-09", "2026-11-10": "2026-11-16", "2025-11-25": "2025-12-15"}
    monthly = calendars.rate_published(spark.createDataFrame([("2026-05-01",)], "d string").select(F.to_date("d").alias("d")), "d", "monthly", cal).select(F.timestamp_millis("published_at").cast("string")).first()[0]
    assert monthly == "2026-06-02 20:30:00"


def test_schedules(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("kind,date,time,zone,source\n# note\ncpi,2026-01-13,08:30,America/New_York,x\nfomc,2026-01-28,14:00,America/New_York,x\n")
    e = calendars.load_schedule(spark, str(p), ["cpi", "fomc"])
    a, b = sorted(r["at"] for r in e.collect())
    assert [r.published_at for r in calendars.published(e, 5).orderBy("at").collect()] == [5, a + 60_000]
    assert calendars.next_event(e, a + 59_999).first()["at"] == a and calendars.next_event(e, a + 60_000).first()["at"] == b
    assert calendars.next_event(e, b + 60_000).first()["at"] is None if calendars.next_event(e, b + 60_000).count() else True
    with pytest.raises(Exception, match="unknown kind"):
        calendars.load_schedule(spark, str(p), ["cpi"])


def test_news_hour(spark):
    ev = [("1", "010", "010", 4, "-10", 2, "-5", "US"), ("2", "130", "13", 4, "-8", 2, "-4", "US"), ("3", "140", "14", 3, "-6", 2, "-5", "US"), ("4", "163", "18", 3, "-3", 2, "-4", "US"), ("4", "163", "18", 3, "-3", 2, "-4", "US"), ("5", "010", "01", 1, "1", 9, "1", "FR")]
    df = spark.createDataFrame([(T0 // 3600000 * 3600000 + 900_000, n, *x) for n, x in enumerate(ev)], "stamp long, ordinal long, id string, base string, root string, quad int, goldstein string, articles int, tone string, country string")
    got = {r.region: r for r in aggregates.news_hours(df, spark).collect()}
    us = got["US"]
    assert set(got) == {"GLOBAL", "US", "EU"}
    assert (us.events, us.articles, us.material_conflict, us.verbal_conflict, us.threats, us.protests, us.sanctions, us.violence) == (4, 8, 2, 2, 1, 1, 1, 1)
    assert (str(us.goldstein), str(us.tone)) == ("-6.75000000", "-4.50000000")


def test_snapshots_round_trip_and_tell_damage():
    s = schema.parse_schema(validate.EXAMPLE_TEXT)
    base = {"dataset": s.name, "scope": "US", "revision": 1, "effective_at": T0, "availability": "derived", "source": "s", "source_version": "", "parser": "p", "raw_ref": None, "period_start": None, "period_end": 7}
    data = [base | {"key": k, "known_at": T0 + n, "seq": n, "fields": json.dumps({"kind": n % 4, "value": v})} for n, (k, v) in enumerate([("b", "1.5"), ("a", None), ("é", "-0.00000001")])]
    blob = snapshot.encode(s, data[::-1])
    header, back = snapshot.decode(blob)
    assert blob == snapshot.encode(s, data) and header["records"] == 3
    assert [(r["key"], json.loads(r["fields"])) for r in back] == [(r["key"], json.loads(r["fields"])) for r in data]
    assert back[0]["period_start"] is None and back[0]["period_end"] == 7 and back[0]["raw_ref"] is None
    for broken in (blob[:-1], blob[:50] + bytes([blob[50] ^ 1]) + blob[51:], b"QKH2" + blob[4:], b""):
        with pytest.raises(StoreError):
            snapshot.decode(broken)
    with pytest.raises(StoreError):
        snapshot.encode(s, [base | {"dataset": "mkt.other.x"}])
    assert snapshot.decode(snapshot.encode(s, []))[1] == []


def test_hashes_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(str(k), "w") for k in range(300)], "id string, window string")
    a = snapshot.window_hashes(df)
    assert a.first() == snapshot.window_hashes(df.repartition(7).orderBy(F.rand(3))).first()
    assert snapshot.compare(a, a).count() == 0 and snapshot.compare(a, snapshot.window_hashes(df.where("id <> '7'"))).first().problem == "content differs"


def test_journal_layouts(spark, tmp_path):
    j = store(spark, [("US", "a", 1, T0, "observed", 1), ("US", "b", 1, T0 + DAY, "observed", 2)])
    journal.append(j, str(tmp_path / "p"))
    got = journal.read(spark, str(tmp_path / "p"))
    assert journal.integrity(got).count() == 0 and got.count() == 2
    more = journal.numbered(rows(spark, [("US", "c", 1, T0 - DAY, "derived", 3)]), got.drop("day"))
    assert more.first().seq == 3
    journal.export_ndjson(got.drop("day"), str(tmp_path / "n"))
    part = next((tmp_path / "n").rglob("*.txt"))
    (part.parent / "torn.txt").write_text('{"dataset":"mkt.te')
    back, bad = journal.import_ndjson(spark, str(tmp_path / "n"))
    assert journal.integrity(back).count() == 0 and back.count() == 2 and bad.count() == 1
    with journal.writer_lock(str(tmp_path)), pytest.raises(StoreError), journal.writer_lock(str(tmp_path)):
        pass
    with pytest.raises(StoreError):
        journal.append(j.withColumn("scope", F.lit("bad.scope")), str(tmp_path / "q"))


def test_formats(spark, tmp_path):
    (tmp_path / "m.txt").write_text("12 abc http://x/20261026010000.export.CSV.zip\n13 def http://x/20261026010000.mentions.CSV.zip\n")
    got = formats.master_list(spark, str(tmp_path / "m.txt")).collect()
    assert [(r.size, r.md5, r.stamp) for r in got] == [(12, "abc", "20261026010000")]
    (tmp_path / "f.csv").write_text("time,rate,price\n1700000000000,0.0001,\n1700000000001,,5\n")
    got = formats.funding_csv(spark, str(tmp_path / "f.csv"), "BTCUSD").collect()
    assert len(got) == 1 and got[0].mark_price is None and got[0].known_at == T0
    cal = calendars.calendar(spark, "2024-01-01", "2024-12-31")
    (tmp_path / "r.csv").write_text("observation_date,DGS10\n2024-06-12,4.1\n2024-06-14,.\n")
    got = formats.rates_csv(spark, str(tmp_path / "r.csv"), "DGS10", cal).orderBy("period_start").collect()
    assert [None if r.value is None else float(r.value) for r in got] == [4.1, None]
    hour = spark.createDataFrame([('{"end":1}', "a\nb")], "h string, t string").select(formats.compact_hour("h", "t").alias("content"))
    assert [r.value for r in formats.expand_hour(hour).collect()] == ["a", "b"]


def test_streams_equal_batches(spark, tmp_path):
    facts = [("US", f"k{n % 5}", 1, T0 + n, "observed", n % 3 if n % 2 else 0) for n in range(40)]
    j = store(spark, facts)
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for low in (0, 20):
        j.where(f"seq > {low} and seq <= {low + 20}").coalesce(1).write.mode("append").parquet(src)
        s = streaming.revisions(spark.readStream.schema(j.schema).parquet(src))
        s.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, r.seq, r.revision) for r in spark.read.parquet(out).collect()}
    want = revise.assign_revisions(j.select("key", "seq", "fields"), ["key"], ["seq"], F.col("fields"))
    assert got == {(r.key, r.seq, r.revision) for r in want.collect()}


def test_stream_into_journal(spark, tmp_path):
    s = schema.parse_schema(RATES)
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    for part in ([(0, "1"), (1, "2")], [(1, "2"), (2, "x"), (3, "5")]):
        candidates(spark, part).drop("arrival").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(candidates(spark, part).drop("arrival").schema).parquet(src)
        streaming.into_journal(stream, s, root, str(tmp_path / "check"), live=False).awaitTermination()
    got = journal.read(spark, root + "/journal").orderBy("seq").collect()
    assert [(r.seq, r.revision, json.loads(r.fields)["value"]) for r in got] == [(1, 1, "1"), (2, 1, "2"), (3, 1, "5")]
    assert spark.read.json(root + "/quarantine").count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/r.yaml").write_text(RATES)
    lines = [json.dumps({"scope": "USD", "effective_at": T0 + k * DAY, "known_at": T0 + k * DAY, "period_start": T0 + k * DAY, "fields": {"value": str(k)}}) for k in range(3)]
    (tmp_path / "b.ndjson").write_text("\n".join(lines) + "\n")
    base = ["--root", str(tmp_path / "s"), "--datasets", str(tmp_path / "d")]
    assert cli.main([*base, "validate"]) == 0
    assert cli.main([*base, "backfill", "rates.us.test", str(tmp_path / "b.ndjson")]) == 0
    assert "written=3" in capsys.readouterr().out
    assert cli.main([*base, "compile"]) == 0 and cli.main([*base, "verify"]) == 0
    assert cli.main([*base, "as-of", "rates.us.test", "USD", str(T0 + DAY)]) == 0
    assert capsys.readouterr().out.count("rev=1") == 2
    assert cli.main([*base, "health"]) == 3 and cli.main([*base, "backfill", "no.such", "x"]) == 3
    doc = journal.load_manifest(str(tmp_path / "s"))
    doc["datasets"]["rates.us.test"]["windows"][0]["sha256"] = "0"
    journal.save_manifest(str(tmp_path / "s"), doc["datasets"])
    assert cli.main([*base, "verify"]) == 3
    with pytest.raises(ConfigError):
        cli.instant("2026-01-01T00:00:00")
    assert cli.instant("2026-01-01T00:00:00Z") == 1767225600000


COLLECTED = """
dataset: rates.us.web
version: 1
title: A rate
scope_kind: currency
key: [effective_at, scope]
fields:
  value: { type: number, null_policy: allow }
collector:
  kind: http_KIND
  url: http://host/rates
  scope: { const: USD }
  effective_at: { from: day, parse: iso8601_with_offset }
  fields:
    value: { parse: human_number }
"""


class Server:
    """Answers in turn; each answer is (status, content type, body), and a tag that it answers 304 to."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, request, timeout):
        self.asked.append(dict(request.header_items()))
        status, kind, body = self.answers.pop(0)
        tag = hashlib.md5(body).hexdigest()
        if status != 200 or self.asked[-1].get("If-none-match") == tag:
            raise urllib.error.HTTPError(request.full_url, status if status != 200 else 304, "", {}, None)
        answer = io.BytesIO(body)
        answer.headers = {"Content-Type": kind, "ETag": tag}
        return answer


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_collect(spark, tmp_path, kind):
    s, root = schema.parse_schema(COLLECTED.replace("KIND", kind)), str(tmp_path / "s")

    def body(*values):
        days = [f"2026-01-0{k + 1}T00:00:00Z" for k in range(len(values))]
        if kind == "json":
            return json.dumps([{"day": d, "value": v} for d, v in zip(days, values)]).encode()
        return "\n".join(["day,value", *map(",".join, zip(days, values))]).encode()

    mime = {"json": "application/json", "csv": "text/csv"}[kind]
    server = Server((200, mime, body("1", "x", "3")), (200, mime, body("1", "x", "3")), (503, mime, b"down"), (200, "text/html", b"<p>"), (200, mime, b""), (200, mime, body("1", "2", "4")))
    got = [collect.collect_once(spark, root, s, server) for _ in range(6)]
    assert [(r["ok"], r["written"]) for r in got] == [(True, 2), (True, 0), (False, 0), (False, 0), (False, 0), (True, 2)]
    assert [r["error"] for r in got[1:4]] == ["unchanged", "status 503", "content type 'text/html', not " + kind]
    assert got[0]["quarantined"] == 1 and got[5]["revisions"] == 1 and got[5]["duplicates"] == 1
    assert "If-none-match" not in server.asked[0] and "If-none-match" in server.asked[5]
    rows_ = journal.read(spark, root + "/journal").orderBy("seq").collect()
    assert [(r.seq, r.revision, json.loads(r.fields)["value"]) for r in rows_] == [(1, 1, "1"), (2, 1, "3"), (3, 1, "2"), (4, 2, "4")]
    assert {r.raw_ref for r in rows_} == {hashlib.sha256(body("1", "x", "3")).hexdigest(), hashlib.sha256(body("1", "2", "4")).hexdigest()}
    assert journal.read_json(f"{root}/status/rates.us.web.json")["written"] == 2
    with pytest.raises(ConfigError):
        collect.collect_once(spark, root, schema.parse_schema(RATES), server)


def test_places_over_many_ranges(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("x"), (F.col("id") % 3).cast("string").alias("g"))
    got = runtime.placed(df.repartition(7), "x", "at", ["g"]).collect()
    for g in "012":
        xs = sorted((r.x, r["at"]) for r in got if r.g == g)
        assert [a for _, a in xs] == list(range(len(xs)))
    assert runtime.placed(df.where("x < 0"), "x", "at").count() == 0


def test_fold_meets_the_latest_revisions_only(spark):
    """A key revised before and a scope without candidates: as a fold over everything."""
    s, r = schema.parse_schema(RATES), random.Random(4)
    first = candidates(spark, [(k % 6, str(r.randint(0, 3))) for k in range(40)])
    then = candidates(spark, [(k % 8, str(r.randint(0, 3))) for k in range(24)])
    columns = ["scope", "key", "revision", "known_at", "effective_at", "availability", "fields", "period_start", "period_end"]
    done = revise.ingest(first, s, 1 << 60).where("outcome = 'written'").select(*columns, F.lit(s.name).alias("dataset"), F.lit("t").alias("source"), F.lit("").alias("source_version"), F.lit("p").alias("parser"), F.lit(None).cast("string").alias("raw_ref"), "arrival")
    have = journal.numbered(done, None)
    other = have.withColumn("scope", F.lit("EUR"))
    got = revise.ingest(then, s, 1 << 60, journal=have.unionByName(other)).collect()
    both = revise.ingest(first.unionByName(then.withColumn("arrival", F.col("arrival") + 1000)), s, 1 << 60).where("arrival >= 1000").collect()
    key = lambda x: x.arrival % 1000
    assert [(x.outcome, x.revision, x.fields) for x in sorted(got, key=key)] == [(x.outcome, x.revision, x.fields) for x in sorted(both, key=key)]


def test_near_reads(spark):
    facts = spark.createDataFrame([("e", T0 + 1000, 1, 1.5)], "u string, known_at long, seq long, value double")
    probes = spark.createDataFrame([("e", T0 + 1000, 1), ("e", T0 + 1999, 2), ("f", T0, 3)], "u string, at long, p long")
    got = {r.p: r.value for r in asof.as_of_many(facts, probes, ["u"], "at", "p", F.col("value"), 999).collect()}
    assert got == {1: None, 2: 1.5, 3: None}


class Feed:
    """A code source: two facts on the first poll, then nothing."""

    parser, max_age_ms, left = "feed@1", None, 1

    def candidates(self, spark, now_ms, timeout):
        if Feed.left == 0:
            return None
        Feed.left -= 1
        rows = [("USD", T0 + k * DAY, T0 + k * DAY, json.dumps({"value": str(k)}), None, None, "published", None, None, k) for k in range(2)]
        return spark.createDataFrame(rows, "scope string, effective_at long, known_at long, fields string, period_start long, period_end long, availability string, title string, parse_error string, arrival long")


CODE = COLLECTED.split("collector:")[0].replace("rates.us.web", "rates.us.code") + "collector:\n  kind: code\n  module: tests.test_engine\n  class: Feed\n"


def test_run_isolates_and_retries(spark, tmp_path):
    """A dataset whose server is down is tried again after retry_seconds; the others go on; windows carry the field table."""
    module = __name__
    reg = schema.Registry({s.name: s for s in (schema.parse_schema(CODE.replace("tests.test_engine", module)), schema.parse_schema(COLLECTED.replace("KIND", "json")))})
    conf = config.parse_config("poll: { retry_seconds: 10, failures_before_alert: 2 }\ncompile: { on_start: true }", str(tmp_path / "s"))
    server = Server((503, "application/json", b""), (503, "application/json", b""))
    now = [1000.0]

    class Enough(Exception):
        pass

    def sleep(seconds):
        now[0] += 11
        if len(server.asked) == 2:
            raise Enough

    with pytest.raises(Enough):
        collect.run(spark, reg, conf, opener=server, clock=lambda: now[0], sleep=sleep)
    root = conf.root
    assert journal.read_json(f"{root}/status/rates.us.web.json")["alert"] and os.path.exists(f"{root}/heartbeat")
    assert journal.read(spark, f"{root}/journal").count() == 2
    assert journal.load_manifest(root)["datasets"]["rates.us.code"]["fields"][0]["null_policy"] == "allow"
    assert collect.run(spark, reg, conf, once=True, opener=Server((503, "application/json", b""))) == ["rates.us.code", "rates.us.web"]
    with pytest.raises(ConfigError):
        code.load_source("a.b", {"kind": "code", "module": module, "class": "Feed", "odd": 1})
    with pytest.raises(ConfigError):
        code.load_source("a.b", {"kind": "code", "module": module, "class": "None such"})


def test_config():
    c = config.parse_config("root: /x\npolicy: { refuse_derived: true }")
    assert (c.root, c.policy.refuse_derived, c.policy.stale_after_ms, c.server["port"], c.compile["every_seconds"]) == ("/x", True, 900_000, 8431, 3600.0)
    for bad in ("rot: /x", "poll: { timeout: 1 }", "poll: { timeout_seconds: soon }", "policy: { refuse_derived: 1 }"):
        with pytest.raises(ConfigError):
            config.parse_config(bad)


def test_months_that_failed_are_written_again(spark, tmp_path):
    hour = 1_704_067_200_000  # 2024-01-01 00:00, which closes December
    rows = spark.createDataFrame([(hour, "a"), (hour + 3_600_000, "b")], "hour long, id string")
    presence = spark.createDataFrame([(hour, 4), (hour + 3_600_000, 3)], "hour long, batches int")
    none = rows.where("false")

    def go(rows, failures):
        state = formats.write_months(rows, aggregates.month_coverage(presence, rows, none, failures), str(tmp_path / "m"))
        lines = {r.month: r.value for r in spark.read.schema("value string, month string").text(str(tmp_path / "m/months")).collect()}
        return {r.month: (r.listed, r.expected, r.failed, r.done) for r in state.collect()}, lines

    assert go(rows, rows.where("id = 'b'")) == ({"2023-12": (4, 4, 0, True), "2024-01": (3, 4, 1, False)}, {"2023-12": '{"id":"a"}', "2024-01": '{"id":"b"}'})
    state, lines = go(rows.withColumn("id", F.upper("id")), none)
    assert state["2024-01"] == (3, 4, 0, True) and lines == {"2023-12": '{"id":"a"}', "2024-01": '{"id":"B"}'}


def test_scratch_tables_are_released(spark):
    since = runtime.written()
    a, b = (runtime.stored(spark.range(3), "kept") for _ in range(2))
    assert runtime.release(spark, since, keep=1) == since + 1 and b.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_windows_are_encoded_in_pieces(spark, monkeypatch):
    """Piece by piece, with its trailer, each window is what encode() gives; no task holds one; a lost piece is told."""
    s, r = schema.parse_schema(validate.EXAMPLE_TEXT), random.Random(5)
    names = ["dataset", *snapshot.CANONICAL_ORDER, "effective_at", "period_start", "period_end", "availability", "source", "source_version", "parser", "raw_ref", "fields"]
    data = []
    for n in range(2600):
        at = T0 + (40 * DAY if n % 10 == 0 else 0) + r.randint(0, 50)
        payload = {"kind": r.choice([None, 0, 3]), "value": r.choice([None, "-0.00000001", "1.5", "92233720368.5"])}
        data.append([s.name, at, r.choice(["US", "DE", "JP"]), r.choice(["é", "Z", "a|", "\U0001f600", f"k{n}", "long" * 3000]), r.randint(1, 2), n, at - 7, r.choice([None, 5]), None, r.choice(snapshot.AVAILABILITY), "s", "", r.choice(["p@1", "p@2"]), r.choice([None, f"raw/{n % 700}"]), json.dumps(payload)])
    kinds = ["string", "long", "string", "string", "int", "long", "long", "long", "long", "string", "string", "string", "string", "string", "string"]
    j = spark.createDataFrame(data, ", ".join(map(" ".join, zip(names, kinds)))).repartition(5).withColumn("month", F.date_format(F.timestamp_millis("known_at"), "yyyy-MM"))
    want = {}
    for row in data:
        want.setdefault("2023-11" if row[1] < T0 + DAY else "2023-12", []).append(dict(zip(names, row)))
    want = {m: snapshot.encode(s, rows) for m, rows in want.items()}
    for small in (snapshot.SMALL_DICTIONARY, 0):
        monkeypatch.setattr(snapshot, "SMALL_DICTIONARY", small)
        parts = runtime.stored(snapshot.pieces(j, s), "pieces")
        assert parts.agg(F.max(F.length("content"))).first()[0] <= snapshot.PIECE_BYTES
        got = {}
        for p in parts.orderBy("month", "section", "at", "part").collect():
            got[p.month] = got.get(p.month, b"") + bytes(p.content)
        ends = {x.month: x for x in snapshot.sealed(parts, s).collect()}
        assert {m: b + bytes(ends[m].trailer) for m, b in got.items()} == want
        assert all(snapshot.decode(b)[0]["records"] == ends[m].records and hashlib.sha256(b).hexdigest() == ends[m].sha256 for m, b in want.items())
    plan = snapshot.encoded(j, validate.EXAMPLE_TEXT)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and snapshot.encoded(j.limit(0), validate.EXAMPLE_TEXT).count() == 0
    for lost in ("section = 2 and part = 0", "section = 2 and part = 1", "section = 7 and at = 1024", "section = 18", "section = 0"):
        with pytest.raises(Exception, match="StoreError"):
            snapshot.sealed(parts.where(f"not (month = '2023-11' and {lost})"), s).collect()
    with pytest.raises(Exception, match="rows of another dataset"):
        snapshot.encoded(j.withColumn("dataset", F.lit("mkt.other.x")), validate.EXAMPLE_TEXT).collect()


def test_fold_streams_and_keeps_what_it_reads(spark, monkeypatch):
    """Rows come out before later ones are read; a key keeps only what derived fields read; blocks are as one sorted list."""
    s = schema.parse_schema(validate.FOLD_TEXT, overflow="round_half_even_8")
    kind = "g string, stored string, scope string, effective_at long, known_at long, period_start long, period_end long, availability string, title string, fields string, parse_error string, arrival long"
    read = []

    def batches():
        for n in range(6):
            read.append(n)
            yield runtime.arrow_batch([(f"U{n // 3}", None, f"U{n // 3}", T0 + k * 100 - n, T0 + k, None, None, "derived", None, f'{{"user":"{k}","value":"{k * k % 7 + n}"}}', None, n * 50 + k) for k in range(50)], kind)

    done = revise.folded(s, 1 << 60)(batches())
    assert next(done).num_rows == 50 and read == [0]
    assert [b.num_rows for b in done] == [50] * 5 and read == list(range(6))
    assert list(revise.folded(s, 1 << 60)(iter([]))) == []
    fold = revise.Fold(s, 1 << 60, False)
    fold.step({"parse_error": None, "known_at": T0, "effective_at": T0, "scope": "U", "fields": '{"user":"x","value":"2"}'})
    assert fold.read == ["change", "value"] and fold.history["U"].payloads() == [(None, "2")]
    events = spark.createDataFrame([(0, "2024-01-01", 3, 1.5)], "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    assert "FlatMapGroups" not in validate.example_ingest(events)._jdf.queryExecution().toString()

    monkeypatch.setattr(revise.History, "BLOCK", 4)
    r, h, plain = random.Random(8), revise.History(), {}
    for n in range(3000):
        at, key = r.choice([None, *range(60)]), f"k{r.randint(0, 90 if n % 1000 < 700 else 5)}"
        order = sorted((-(1 << 63) if a is None else a, k) for k, (a, _) in plain.items() if k != key)
        end = [x for x in order if x < (-(1 << 63) if at is None else at, key)]
        assert h.before(at, key, 7) == [plain[k][1] for _, k in end[-7:]]
        h.upsert(at, key, n)
        plain[key] = at, n
    assert len(h.blocks) > 3 and len(h.blocks) == len(h.lows)

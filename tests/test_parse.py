from decimal import Decimal

import pytest

from pitstore.functions import canon, parse
from pitstore.model import ConfigError
from pyspark.sql import functions as F


def run(spark, raws, build):
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string")
    p = build(F.col("raw"))
    return [(r["v"], r["e"] is not None) for r in rows.select("k", p.value.alias("v"), p.error.alias("e")).orderBy("k").collect()]


def test_percent_or_number(spark):
    raws = ["0.30%", "-1.2%", "1,234", "", " ", "-", "n/a", "N/A", "—", "1.2K", "3.4M", "2B", None, "1.2.5%", "<1.25%"]
    want = ["0.3", "-1.2", "1234", None, None, None, None, None, None, "1200", "3400000", "2000000000", None, None, None]
    got = run(spark, raws, parse.percent_or_number)
    assert [None if v is None else v.normalize() for v, _ in got] == [None if w is None else Decimal(w).normalize() for w in want]
    assert [e for _, e in got] == [False] * 13 + [True, True]


def test_human_number(spark):
    assert [(v and int(v), e) for v, e in run(spark, ["1,234K", "not-a-number", "+5", "1_000"], parse.human_number)] == [(1234000, False), (None, True), (5, False), (1000, False)]


def test_iso_needs_an_offset(spark):
    got = run(spark, ["2026-09-10T08:15:00-04:00", "2026-09-10T08:15:00", "2026-0910", "2026-09-10T12:15:00Z", "2026-09-10T08:15:00-0400", "2026-13-10T08:15:00Z"], parse.iso8601_with_offset)
    assert got == [(1789042500000, False), (None, True), (None, True), (1789042500000, False), (1789042500000, False), (None, True)]


def test_epochs(spark):
    assert run(spark, ["1789516800", "1789516800.123", "1789516800.1234", "x"], parse.epoch_seconds) == [(1789516800000, False), (1789516800123, False), (None, True), (None, True)]
    assert run(spark, ["1789516800123", "1.5"], parse.epoch_millis) == [(1789516800123, False), (None, True)]


def test_date_in_zone(spark):
    got = run(spark, ["2026-07-01", "2026-01-01", "2026-09-01T00:00:00.000", "bad"], lambda c: parse.date_in_zone(c, "America/New_York", 8))
    assert [v for v, _ in got][:2] == [1782907200000, 1767272400000]
    assert got[2][0] is not None and got[3] == (None, True)


def test_enum_and_boolean(spark):
    assert run(spark, ["HIGH", "weird", "-"], lambda c: parse.enum_ordinal(c, {"low": 0, "high": 2})) == [(2, False), (None, False), (None, False)]
    assert run(spark, ["Yes", "n", "maybe", ""], parse.boolean) == [(True, False), (False, False), (None, True), (None, False)]
    with pytest.raises(ConfigError):
        parse.apply("nope", F.lit("x"))


def test_null_if(spark):
    got = spark.createDataFrame([("-",), (" < 3",), ("7",)], "raw string").select(parse.null_if(F.col("raw"), ["-"], ["<"]).alias("v")).collect()
    assert [r.v for r in got] == [None, None, "7"]


def test_decimal_text(spark):
    values = ["100", "0.30", "0", "-0", "0.00000001", "-12.50"]
    rows = spark.createDataFrame([(k, Decimal(v)) for k, v in enumerate(values)], "k int, v decimal(19,8)")
    got = [r.t for r in rows.select("k", canon.decimal_column(F.col("v")).alias("t")).orderBy("k").collect()]
    assert got == ["100", "0.3", "0", "0", "0.00000001", "-12.5"] == [canon.decimal_text(Decimal(v)) for v in values]


def test_identity_is_the_hash_of_canonical_json(spark):
    row = {"dataset": "mkt.a.b", "scope": "US", "key": 'k"é', "revision": 1, "known_at": 5, "effective_at": 6, "availability": "observed", "source": "s", "fields": '{"a":"1"}', "period_start": None, "period_end": 7, "source_version": "", "parser": "p", "raw_ref": None, "seq": 3}
    df = spark.createDataFrame([tuple(row.values())], "dataset string, scope string, key string, revision int, known_at long, effective_at long, availability string, source string, fields string, period_start long, period_end long, source_version string, parser string, raw_ref string, seq long")
    doc = {k: v for k, v in row.items() if v is not None and k != "seq"} | {"fields": {"a": "1"}, "v": 1}
    assert df.select(canon.content_id()).first()[0] == "sha256:" + canon.sha256_text(canon.canonical_json(doc))

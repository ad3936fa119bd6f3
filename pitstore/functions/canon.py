"""Canonical text: decimals, JSON, content identity."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ENVELOPE_VERSION, RecordError

NULL_I64 = -(1 << 63)


def decimal_text(value: Decimal) -> str:
    """Plain digits, no exponent, no plus, no trailing zeros, no negative zero."""
    if not value.is_finite():
        raise RecordError(f"not a finite number: {value}")
    text = format(value, "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def decimal_column(c: Column) -> Column:
    """The same of a DECIMAL column, without Python (ANSI casts print plain digits)."""
    text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def canonical_json(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_fields(raw: pd.Series) -> pd.Series:
    """Any JSON object text in canonical form; floats are refused, as they have no one decimal text."""

    def one(text):
        if text is None:
            return None
        return canonical_json(json.loads(text, parse_float=_no_float))

    return raw.map(one)


def _no_float(text: str):
    raise RecordError(f"a float has no place in a payload: {text}")


def _json_text(c: Column) -> Column:
    return F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def identity_json() -> Column:
    """Canonical JSON of a journal row without seq and id: keys sorted, absent optionals left out.

    The keys are fixed, so their order is written down; `fields` is canonical JSON already. All JVM-side.
    """
    parts = [
        ("availability", _json_text(F.col("availability"))),
        ("dataset", _json_text(F.col("dataset"))),
        ("effective_at", F.col("effective_at").cast("string")),
        ("fields", F.col("fields")),
        ("key", _json_text(F.col("key"))),
        ("known_at", F.col("known_at").cast("string")),
        ("parser", _json_text(F.col("parser"))),
        ("period_end", F.col("period_end").cast("string")),
        ("period_start", F.col("period_start").cast("string")),
        ("raw_ref", F.when(F.col("raw_ref").isNotNull(), _json_text(F.col("raw_ref")))),
        ("revision", F.col("revision").cast("string")),
        ("scope", _json_text(F.col("scope"))),
        ("source", _json_text(F.col("source"))),
        ("source_version", _json_text(F.col("source_version"))),
        ("v", F.lit(str(ENVELOPE_VERSION))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts]), F.lit("}"))


def content_id() -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(identity_json(), 256))


def payload_hash(fields: Column | str = "fields") -> Column:
    return F.sha2(fields, 256)


def utc_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def utc_month(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def month_bounds(window: Column) -> tuple[Column, Column]:
    """Inclusive millisecond bounds of a yyyy-MM text."""
    first = F.to_timestamp(F.concat(window, F.lit("-01")), "yyyy-MM-dd")
    return F.unix_millis(first), F.unix_millis(F.to_timestamp(F.add_months(first, 1))) - 1


def stamp_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMddHHmmss")


def batch_stamps(hour_end: Column) -> Column:
    """The four quarter-hour stamps of the hour that ends there, its own end included."""
    return F.sequence(hour_end - 45 * 60_000, hour_end, F.lit(15 * 60_000).cast("long"))


def to_fixed(c: Column) -> Column:
    """DECIMAL(19,8) as a scaled long, the null sentinel for null."""
    return F.coalesce((c * 100_000_000).cast("decimal(38,0)").cast("long"), F.lit(NULL_I64))


def from_fixed(c: Column) -> Column:
    return F.when(c != NULL_I64, (c.cast("decimal(28,0)") / F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(19,8)"))

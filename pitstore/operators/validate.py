"""Row-level validation: every row keeps its first broken rule; nothing fails a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import DatasetSchema, parse_schema

EXAMPLE_TEXT = """
dataset: mkt.test.events
version: 1
title: A value and its kind
scope_kind: instrument
key: [effective_at, scope]
fields:
  value: { type: number, unit: usd }
  kind: { type: enum, values: [a, b, c, d] }
quality:
  range: { value: [0, 150] }
"""
EXAMPLE = parse_schema(EXAMPLE_TEXT)


def with_reason(rows: DataFrame, schema: DatasetSchema, text: dict[str, Column], out: str = "reason") -> DataFrame:
    return rows.withColumn(out, schema.problem(text))


def split(rows: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined)."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())


def clock_problem(now_ms: int, max_age_ms: int | None = None, skew_ms: int = 5_000) -> Column:
    """Known in the future, or observed live though older than anything could still be seen."""
    out = F.when(F.col("known_at") > now_ms + skew_ms, "known_at lies in the future")
    if max_age_ms is not None:
        out = out.when((F.col("availability") == "observed") & (F.col("effective_at") < now_ms - max_age_ms), "too old to have been observed live")
    return out


FOLD_TEXT = """
dataset: mkt.test.events
version: 1
title: A value, its change and its z-score
scope_kind: instrument
key: [scope, user]
fields:
  user: { type: string }
  value: { type: number }
  change: { type: number, derived: "diff(value, 1)", null_policy: allow }
  change_z: { type: number, derived: "zscore(change, window=12, min_obs=4)", null_policy: allow }
"""


def example_ingest(events: DataFrame) -> DataFrame:
    from . import revise

    schema = parse_schema(FOLD_TEXT, overflow="round_half_even_8")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    fields = F.concat(F.lit('{"user":"'), F.col("user_id").cast("string"), F.lit('","value":"'), F.floor("value").cast("string"), F.lit('"}'))
    none = F.lit(None).cast("long")
    rows = events.select(
        F.concat(F.lit("U"), (F.col("user_id") % 7).cast("string")).alias("scope"), ms.alias("effective_at"), ms.alias("known_at"), none.alias("period_start"), none.alias("period_end"), F.lit("derived").alias("availability"), F.lit(None).cast("string").alias("title"), fields.alias("fields"), F.lit(None).cast("string").alias("parse_error"), F.col("event_id").alias("arrival")
    )
    return revise.ingest(rows, schema, now_ms=4_000_000_000_000)

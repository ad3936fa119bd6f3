"""The record envelope, its Spark types and the error family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PitError(Exception):
    """Any failure that the engine reports on purpose."""


class ConfigError(PitError):
    """A configuration or collector block that is not well formed."""


class SchemaError(ConfigError):
    """A dataset schema that is not well formed."""


class RecordError(PitError):
    """A record that breaks the envelope."""


class ParseError(PitError):
    """A raw value that its parser refuses."""


class StoreError(PitError):
    """A store that is missing, corrupt or inconsistent."""


# Fixed values of the record format.
ENVELOPE_VERSION = 1
MIN_MS, MAX_MS = 946_684_800_000, 4_102_444_800_000  # 2000-01-01, 2100-01-01
DATASET_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z0-9_]+){1,4}$"
SCOPE_PATTERN = r"^(?=[A-Z0-9_:-]*[A-Z])[A-Z0-9_:-]{1,64}$"
FIELD_PATTERN = r"^[a-z][a-z0-9_]*$"
DOMAINS = ("macro", "cal", "rates", "cb", "pos", "inv", "corp", "venue", "mkt", "text", "hub")
RESERVED_FIELDS = ("known_at", "effective_at", "revision")
AVAILABILITY = ("observed", "published", "derived")
SCOPE_KINDS = ("currency", "instrument", "issuer", "region", "all")
NULL_POLICIES = ("forbid", "allow", "allow_until_release")
FIELD_TYPES = ("number", "bool", "timestamp", "enum", "string")
SCALE = 8

#: The journal's columns. `fields` holds the payload as canonical JSON text; typed views come from a schema.
JOURNAL = T.StructType(
    [
        T.StructField("dataset", T.StringType(), False),
        T.StructField("scope", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("revision", T.IntegerType(), False),
        T.StructField("known_at", T.LongType(), False),
        T.StructField("effective_at", T.LongType(), False),
        T.StructField("availability", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("fields", T.StringType(), False),
        T.StructField("period_start", T.LongType()),
        T.StructField("period_end", T.LongType()),
        T.StructField("source_version", T.StringType(), False),
        T.StructField("parser", T.StringType(), False),
        T.StructField("raw_ref", T.StringType()),
        T.StructField("seq", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
    ]
)

#: What a source hands to ingestion: the mapped row before it is a record.
CANDIDATE = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("effective_at", T.LongType()),
        T.StructField("known_at", T.LongType()),
        T.StructField("period_start", T.LongType()),
        T.StructField("period_end", T.LongType()),
        T.StructField("availability", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("fields", T.StringType()),
        T.StructField("parse_error", T.StringType()),
    ]
)

CANONICAL_ORDER = ("known_at", "scope", "key", "revision", "seq")


def envelope_problem() -> Column:
    """The first rule of the envelope that a row breaks, or null."""
    c = F.col
    checks = [
        (~c("dataset").rlike(DATASET_PATTERN) | ~F.split_part("dataset", F.lit("."), F.lit(1)).isin(*DOMAINS), "dataset"),
        (~c("scope").rlike(SCOPE_PATTERN), "scope"),
        (c("key").isNull() | (c("key") == ""), "key"),
        (c("revision") < 1, "revision"),
        (~c("known_at").between(MIN_MS, MAX_MS), "known_at out of range"),
        (~c("effective_at").between(MIN_MS, MAX_MS), "effective_at out of range"),
        (c("period_start").isNotNull() & ~c("period_start").between(MIN_MS, MAX_MS), "period_start out of range"),
        (c("period_end").isNotNull() & ~c("period_end").between(MIN_MS, MAX_MS), "period_end out of range"),
        (c("period_end") < c("period_start"), "period_end before period_start"),
        (~c("availability").isin(*AVAILABILITY), "availability"),
        (c("source").isNull() | (c("source") == ""), "source"),
        (c("seq") < 0, "seq"),
    ]
    out = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True) if name in ("dataset", "scope", "availability") else F.lit(False)), F.lit(f"envelope: {name}")).otherwise(out)
    return out

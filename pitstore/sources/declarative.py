"""Declarative sources: landed JSON or CSV bytes -> candidates, all as one projection."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from ..model import MIN_MS, ConfigError
from .schema import only

# The keys of a collector block.
COLLECTOR_KEYS = ("kind", "url", "headers", "cadence", "cadence_near_event", "max_observed_age", "record_path", "where", "scope", "effective_at", "known_at", "period_start", "period_end", "fields", "availability", "csv_value_column", "since")
NEAR_KEYS = ("before", "after", "every", "anchor")
SCOPE_KEYS = ("from", "map", "const", "upper")
TIME_KEYS = ("from", "parse", "zone", "hour", "const")
FIELD_KEYS = ("from", "parse", "map", "null_if", "null_if_prefix", "const", "zone", "hour")
KINDS = ("http_json", "http_csv")
KNOWN = ("ingest_time", "effective_at")
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def duration_seconds(text: Any) -> float:
    """30s, 15m, 6h, 1d; a bare number is seconds (F16)."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*", str(text))
    if not m:
        raise ConfigError(f"not a duration: {text!r}")
    return float(m[1]) * UNITS[m[2] or "s"]


@dataclass(frozen=True)
class Cadence:
    """How often a source is read, and how often while one of its events is near."""

    every: float = 3600.0
    before: float = 0.0
    after: float = 0.0
    near: float | None = None

    def interval(self, now: float, events: list[float]) -> float:
        if self.near is not None and any(e - self.before <= now <= e + self.after for e in events):
            return self.near
        return self.every


@dataclass(frozen=True)
class Collector:
    dataset: str
    kind: str
    record_path: str = "$[*]"
    where: dict = field(default_factory=dict)
    scope: dict = field(default_factory=dict)
    times: dict = field(default_factory=dict)
    fields: dict = field(default_factory=dict)
    availability: str = "observed"
    cadence: Cadence = Cadence()
    max_age_ms: int | None = None
    since_ms: int = MIN_MS
    url: str = ""
    headers: dict = field(default_factory=dict)
    known: str = "ingest_time"

    @property
    def parser(self) -> str:
        return f"decl/{self.kind}@1"


def load_collector(dataset: str, raw: Any) -> Collector:
    raw = only(raw, COLLECTOR_KEYS, f"{dataset}: collector")
    if raw.get("kind") not in KINDS:
        raise ConfigError(f"{dataset}: collector kind must be one of {', '.join(KINDS)}")
    path = raw.get("record_path", "$[*]")
    if not re.fullmatch(r"\$(\.[A-Za-z_]\w*)*\[\*\]", path):
        raise ConfigError(f"{dataset}: record_path {path!r} must be $[*] or $.a.b[*]")
    scope = only(raw.get("scope", {}), SCOPE_KEYS, "scope")
    times = {k: only(raw[k], TIME_KEYS, k) for k in ("effective_at", "period_start", "period_end") if k in raw}
    fields = {k: only(v, FIELD_KEYS, f"fields.{k}") for k, v in raw.get("fields", {}).items()}
    for block in (*times.values(), *fields.values()):
        if "parse" in block and block["parse"] not in parse.PARSERS:
            raise ConfigError(f"{dataset}: unknown parser {block['parse']!r}")
    near = only(raw.get("cadence_near_event", {}), NEAR_KEYS, "cadence_near_event")
    cadence = Cadence(duration_seconds(raw.get("cadence", 3600)), duration_seconds(near.get("before", 0)), duration_seconds(near.get("after", 0)), duration_seconds(near["every"]) if near else None)
    since = MIN_MS
    if "since" in raw:
        import datetime as dt

        since = int(dt.datetime.fromisoformat(str(raw["since"])).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    age = raw.get("max_observed_age")
    if (known := raw.get("known_at", "ingest_time")) not in KNOWN:
        raise ConfigError(f"{dataset}: known_at must be one of {', '.join(KNOWN)}")
    headers = {str(k): str(v) for k, v in (raw.get("headers") or {}).items()}
    return Collector(dataset, raw["kind"], path, raw.get("where", {}), scope, times, fields, raw.get("availability", "observed"), cadence, None if age is None else int(duration_seconds(age) * 1000), since, str(raw.get("url", "")), headers, known)


# --- rows -------------------------------------------------------------------------------------------------

ROW = "map<string,string>"


def json_rows(blobs: DataFrame, path: str = "$[*]", content: str = "content") -> DataFrame:
    """One row for each object under the path; a missing path gives none, other values are dropped."""
    text = F.col(content).cast("string")
    inner = F.get_json_object(text, path[:-3]) if path != "$[*]" else text
    items = F.from_json(inner, "array<string>")
    rows = blobs.select(*[c for c in blobs.columns if c != content], F.posexplode(items).alias("ordinal", "item"))
    return rows.where(F.col("item").startswith("{")).select(*[c for c in rows.columns if c != "item"], F.from_json("item", ROW).alias("row"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Header wanted, every value text."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    pairs = [x for c in raw.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    return raw.select(F.create_map(*pairs).alias("row"))


def where(conditions: dict, row: Column) -> Column:
    """All keys must match, by equality or membership, trimmed and whatever the case; a missing value reads `none`."""
    out = F.lit(True)
    for k, v in conditions.items():
        wanted = [str(x).strip().lower() for x in (v if isinstance(v, list) else [v])]
        out = out & F.lower(F.trim(F.coalesce(F.try_element_at(row, F.lit(k)), F.lit("none")))).isin(*wanted)
    return out


def _scope(spec: dict, row: Column) -> Column:
    if "const" in spec:
        out = F.lit(str(spec["const"]))
    elif "from" in spec:
        raw = F.trim(F.try_element_at(row, F.lit(spec["from"])))
        pairs = [F.lit(str(x)) for kv in spec.get("map", {}).items() for x in kv]
        out = F.coalesce(F.try_element_at(F.create_map(*pairs), raw), raw) if pairs else raw
    else:
        out = F.lit("ALL")
    return F.upper(out) if spec.get("upper", True) else out


def _time(spec: dict | None, row: Column) -> parse.Parsed:
    nothing = F.lit(None).cast("string")
    if spec is None:
        return parse.Parsed(F.lit(None).cast("long"), nothing)
    if "const" in spec:
        return parse.Parsed(F.lit(int(spec["const"])).cast("long"), nothing)
    name = spec.get("parse", "iso8601_with_offset")
    options = {k: spec[k] for k in ("zone", "hour") if k in spec}
    out = parse.apply(name, F.try_element_at(row, F.lit(spec["from"])), **options)
    return parse.Parsed(out.value.cast("long"), out.error)


def _field(spec: dict, row: Column, name: str) -> parse.Parsed:
    nothing = F.lit(None).cast("string")
    if "const" in spec:
        return parse.Parsed(F.lit(spec["const"]), nothing)
    raw = parse.null_if(F.try_element_at(row, F.lit(spec.get("from", name))), spec.get("null_if", []), spec.get("null_if_prefix", []))
    if "parse" not in spec:
        return parse.Parsed(raw, nothing)
    options = {k: spec[k] for k in ("zone", "hour") if k in spec}
    if "map" in spec:
        options["mapping"] = spec["map"]
    out = parse.apply(spec["parse"], raw, **options)
    return parse.Parsed(out.value, F.when(raw.isNotNull(), out.error))


def candidates(rows: DataFrame, c: Collector, known_at: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mapped rows with a typed payload struct `payload`; a value that cannot be read marks its own row only.

    Rows without scope or effective time are left out, as are those before the collector's floor. A field is
    read from the cell of its own name unless `from` names another. keep: columns of rows that come along.
    """
    from ..functions.canon import decimal_column

    row = F.col("row")
    kept = rows.where(where(c.where, row))
    at = _time(c.times.get("effective_at"), row)
    start, end = _time(c.times.get("period_start"), row), _time(c.times.get("period_end"), row)
    parsed = {n: _field(s, row, n) for n, s in c.fields.items()}
    errors = F.coalesce(at.error, start.error, end.error, *[p.error for p in parsed.values()], F.lit(None).cast("string"))
    values = []
    for n, p in parsed.items():
        kind = c.fields[n].get("parse", "")
        values.append((decimal_column(p.value) if kind in ("human_number", "percent_or_number") else p.value).alias(n))
    out = kept.select(
        *keep,
        _scope(c.scope, row).alias("scope"),
        at.value.alias("effective_at"),
        known_at.cast("long").alias("known_at"),
        start.value.alias("period_start"),
        end.value.alias("period_end"),
        F.lit(c.availability).alias("availability"),
        F.try_element_at(row, F.lit("title")).alias("title"),
        (F.struct(*values) if values else F.struct(F.lit(None).cast("string").alias("none"))).alias("payload"),
        errors.alias("parse_error"),
    )
    present = F.col("scope").isNotNull() & ((F.col("effective_at") >= c.since_ms) | (F.col("effective_at").isNull() & F.col("parse_error").isNotNull()))
    out = out.where(present)
    return out.withColumn("fields", F.to_json("payload", {"ignoreNullFields": "false"})).drop("payload")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Raw blobs of a landing folder by content address."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])


LANDING = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

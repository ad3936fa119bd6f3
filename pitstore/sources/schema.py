"""Dataset schemas: strict YAML -> checked description -> Spark types and rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr
from ..functions.canon import canonical_json, decimal_text, sha256_text
from ..model import DOMAINS, FIELD_PATTERN, FIELD_TYPES, NULL_POLICIES, RESERVED_FIELDS, SCOPE_KINDS, ConfigError, SchemaError

# The keys that a schema file may hold, and what a key or an expression may name of the envelope.
TOP_KEYS = ("dataset", "version", "title", "scope_kind", "key", "fields", "quality", "value_alias", "collector", "retention")
FIELD_KEYS = ("type", "unit", "values", "null_policy", "derived", "strategy")
QUALITY_KEYS = ("range",)
ENVELOPE_IN_KEY = ("scope", "period_start", "period_end", "effective_at")
ENVELOPE_IN_EXPRESSION = ("known_at", "effective_at")


class _Strict(yaml.SafeLoader):
    """Plain data only: no anchors, tags, dates or repeated keys."""

    def compose_node(self, parent, index):
        if self.check_event(yaml.AliasEvent) or getattr(self.peek_event(), "anchor", None):
            raise ConfigError("anchors and aliases are not allowed")
        if getattr(self.peek_event(), "tag", None):
            raise ConfigError("tags are not allowed")
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len(set(map(str, keys))) != len(keys):
            raise ConfigError(f"repeated key near line {node.start_mark.line + 1}")
        return super().construct_mapping(node, deep)


_Strict.yaml_implicit_resolvers = {c: [r for r in rs if "timestamp" not in r[0] and "merge" not in r[0]] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def load_yaml(text: str) -> Any:
    if "\t" in re.sub(r"#.*", "", text):
        raise ConfigError("tabs are not allowed")
    # a plain value may hold a colon here, which YAML proper wants quoted
    text = re.sub(r"""(?m)^(\s*[\w-]+: +)([^\s"'\[{>|&*!#][^#\n]*?: [^#\n]*?) *$""", lambda m: m[1] + '"' + m[2].replace("\\", "\\\\").replace('"', '\\"') + '"', text)
    try:
        return yaml.load(text, _Strict)  # noqa: S506  a SafeLoader
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e


def only(block: Any, allowed: tuple, what: str) -> dict:
    """A mapping without unknown keys."""
    if not isinstance(block, dict):
        raise SchemaError(f"{what} must be a mapping")
    if odd := sorted(set(map(str, block)) - set(allowed)):
        raise SchemaError(f"{what}: unknown {', '.join(odd)}; allowed: {', '.join(allowed)}")
    return block


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    unit: str = ""
    values: tuple[str, ...] = ()
    null_policy: str = "forbid"
    derived: str = ""
    strategy: bool = True

    def spark_type(self) -> T.DataType:
        return {"number": T.DecimalType(19, 8), "bool": T.BooleanType(), "timestamp": T.LongType(), "enum": T.IntegerType(), "string": T.StringType()}[self.type]

    def check(self, v: Any) -> Any:
        """The stored form of a value, or ValueError with the reason."""
        if v is None:
            if self.null_policy == "forbid":
                raise ValueError(f"{self.name}: null is not allowed")
            return None
        if self.type == "number":
            if isinstance(v, (bool, float, list, dict)):
                raise ValueError(f"{self.name}: not a decimal: {v!r}")
            try:
                d = Decimal(str(v))
            except InvalidOperation:
                raise ValueError(f"{self.name}: not a decimal: {v!r}") from None
            if not d.is_finite():
                raise ValueError(f"{self.name}: not finite")
            scaled = d.scaleb(8)
            if scaled != scaled.to_integral_value():
                raise ValueError(f"{self.name}: more than 8 decimals")
            if not -(1 << 63) < scaled < (1 << 63):
                raise ValueError(f"{self.name}: out of range")
            return decimal_text(d)
        if self.type == "bool" and isinstance(v, bool):
            return v
        if self.type in ("timestamp", "enum") and isinstance(v, int) and not isinstance(v, bool):
            if self.type == "enum" and not 0 <= v < len(self.values):
                raise ValueError(f"{self.name}: no such ordinal: {v}")
            return v
        if self.type == "string" and isinstance(v, str):
            return v
        raise ValueError(f"{self.name}: not a {self.type}: {v!r}")


@dataclass(frozen=True)
class DatasetSchema:
    name: str
    version: int
    title: str
    scope_kind: str
    key: tuple[str, ...]
    fields: dict[str, FieldSpec]
    derived_order: tuple[str, ...]
    ranges: dict[str, tuple] = field(default_factory=dict)
    value_alias: str = ""
    raw: dict = field(default_factory=dict)
    overflow: str = "reject"  # or round_half_even_8

    def hash(self) -> str:
        return sha256_text(canonical_json(self.raw))

    def strategy_fields(self) -> list[FieldSpec]:
        return [f for f in self.fields.values() if f.strategy]

    def storable_fields(self) -> list[FieldSpec]:
        return [f for f in self.fields.values() if f.type != "string"]

    def field_entries(self) -> list[dict]:
        """The field table for the manifest, so that a reader needs no schema file."""
        return [{"name": f.name, "type": f.type, "unit": f.unit, "values": list(f.values), "null_policy": f.null_policy, "derived": f.derived, "strategy": f.strategy} for f in self.fields.values()]

    def derived_fields(self) -> list[FieldSpec]:
        return [self.fields[n] for n in self.derived_order]

    def lookback(self) -> int:
        return max([expr.lookback(f.derived) for f in self.derived_fields()], default=0)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type(), True, {"unit": f.unit, "null_policy": f.null_policy, "values": list(f.values), "derived": f.derived, "strategy": f.strategy}) for f in self.fields.values()])

    def checked(self, payload: dict) -> dict:
        """The payload in stored form; ValueError names the first rule that it breaks."""
        for name in payload:
            if name not in self.fields:
                raise ValueError(f"{name}: not declared")
        out = {n: s.check(payload[n]) for n, s in self.fields.items() if n in payload}
        for name, (low, high) in self.ranges.items():
            v = out.get(name)
            if v is not None and not (Decimal(str(low)) <= Decimal(str(v)) <= Decimal(str(high))):
                raise ValueError(f"{name}: outside [{low}, {high}]")
        return out

    def problem(self, text: dict[str, Column]) -> Column:
        """The same rules over text columns, as one native expression: the first reason, or null."""
        out = F.lit(None).cast("string")
        for name, (low, high) in reversed(list(self.ranges.items())):
            v = text[name].try_cast("decimal(38,10)")
            out = F.when((v < F.lit(str(low)).cast("decimal(38,10)")) | (v > F.lit(str(high)).cast("decimal(38,10)")), f"{name}: outside [{low}, {high}]").otherwise(out)
        for s in reversed(list(self.fields.values())):
            c = text[s.name]
            if s.type == "number":
                wide, kept = c.try_cast("decimal(38,18)"), c.try_cast("decimal(27,8)")
                scaled = F.try_multiply(kept.cast("decimal(27,8)"), F.lit(100_000_000).cast("decimal(9,0)"))
                bound = F.lit("9223372036854775807").cast("decimal(38,0)")
                out = F.when(wide.isNull() & c.isNotNull(), f"{s.name}: not a decimal").when(wide != kept, f"{s.name}: more than 8 decimals").when((scaled > bound) | (scaled < -bound), f"{s.name}: out of range").otherwise(out)
            elif s.type == "bool":
                out = F.when(~c.isin("true", "false"), f"{s.name}: not a bool").otherwise(out)
            elif s.type == "timestamp":
                out = F.when(c.isNotNull() & c.try_cast("long").isNull(), f"{s.name}: not a timestamp").otherwise(out)
            elif s.type == "enum":
                n = c.try_cast("int")
                out = F.when(c.isNotNull() & n.isNull(), f"{s.name}: not an ordinal").when((n < 0) | (n >= len(s.values)), f"{s.name}: no such ordinal").otherwise(out)
            if s.null_policy == "forbid":
                out = F.when(c.isNull(), f"{s.name}: null is not allowed").otherwise(out)
        return out


def _field(name: str, raw: Any, dataset: str) -> FieldSpec:
    what = f"{dataset}: field {name}"
    raw = only(raw, FIELD_KEYS, what)
    if raw.get("type") not in FIELD_TYPES:
        raise SchemaError(f"{what}: type must be one of {', '.join(FIELD_TYPES)}")
    values = raw.get("values", [])
    if raw["type"] == "enum":
        if not isinstance(values, list) or not values or len(set(values)) != len(values) or any(not isinstance(v, str) or not v or v != v.lower() for v in values):
            raise SchemaError(f"{what}: values must be different lower-case labels")
    elif "values" in raw:
        raise SchemaError(f"{what}: only an enum has values")
    if raw.get("null_policy", "forbid") not in NULL_POLICIES:
        raise SchemaError(f"{what}: null_policy must be one of {', '.join(NULL_POLICIES)}")
    if not isinstance(raw.get("strategy", True), bool):
        raise SchemaError(f"{what}: strategy must be true or false")
    derived = raw.get("derived", "")
    if derived:
        if raw["type"] != "number":
            raise SchemaError(f"{what}: only a number can be derived")
        expr.parse(derived)
    return FieldSpec(name, raw["type"], str(raw.get("unit", "")), tuple(values), raw.get("null_policy", "forbid"), derived, raw.get("strategy", True))


def _order(fields: dict[str, FieldSpec], dataset: str) -> tuple[str, ...]:
    """Derived fields, each after those it reads."""
    needs = {n: expr.referenced_names(f.derived) for n, f in fields.items() if f.derived}
    for n, names in needs.items():
        if odd := sorted(x for x in names if x not in fields and x not in ENVELOPE_IN_EXPRESSION):
            raise SchemaError(f"{dataset}: {n} reads undeclared {', '.join(odd)}")
    done: list[str] = []
    while len(done) < len(needs):
        ready = [n for n in sorted(needs) if n not in done and all(x in done or x not in needs for x in needs[n])]
        if not ready:
            raise SchemaError(f"{dataset}: derived fields read each other in a circle: {', '.join(sorted(set(needs) - set(done)))}")
        done += ready
    return tuple(done)


def parse_schema(text: str, overflow: str = "reject") -> DatasetSchema:
    doc = only(load_yaml(text), TOP_KEYS, "schema")
    for k in ("dataset", "version", "title", "scope_kind", "key", "fields"):
        if k not in doc:
            raise SchemaError(f"missing {k}")
    name = doc["dataset"]
    if not isinstance(name, str) or name.split(".")[0] not in DOMAINS:
        raise SchemaError(f"dataset {name!r} must open with one of {', '.join(DOMAINS)}")
    if isinstance(doc["version"], bool) or not isinstance(doc["version"], int):
        raise SchemaError(f"{name}: version must be a whole number")
    if not isinstance(doc["title"], str):
        raise SchemaError(f"{name}: title must be text")
    if doc["scope_kind"] not in SCOPE_KINDS:
        raise SchemaError(f"{name}: scope_kind must be one of {', '.join(SCOPE_KINDS)}")
    if not isinstance(doc["fields"], dict):
        raise SchemaError(f"{name}: fields must be a mapping")
    fields = {}
    for n, raw in doc["fields"].items():
        if not re.match(FIELD_PATTERN, str(n)) or n in RESERVED_FIELDS or n in expr.FUNCTIONS:
            raise SchemaError(f"{name}: {n!r} is no name for a field")
        fields[n] = _field(n, raw, name)
    key = doc["key"]
    if not isinstance(key, list) or not key or any(not isinstance(k, str) for k in key):
        raise SchemaError(f"{name}: key must be a list of names")
    for k in key:
        if k not in fields and k not in ENVELOPE_IN_KEY:
            raise SchemaError(f"{name}: key names undeclared {k!r}")
        if k in fields and fields[k].derived:
            raise SchemaError(f"{name}: key names derived {k!r}")
    ranges = only(doc.get("quality", {}), QUALITY_KEYS, f"{name}: quality").get("range", {}) or {}
    for n, b in ranges.items():
        if n not in fields or not isinstance(b, list) or len(b) != 2:
            raise SchemaError(f"{name}: quality.range {n!r} must be a declared field with [min, max]")
    alias = doc.get("value_alias", "")
    if not isinstance(alias, str) or (alias and alias not in fields):
        raise SchemaError(f"{name}: value_alias names undeclared {alias!r}")
    return DatasetSchema(name, doc["version"], doc["title"], doc["scope_kind"], tuple(key), fields, _order(fields, name), {n: tuple(b) for n, b in ranges.items()}, alias, doc, overflow)


def load_schema(path: str | Path) -> DatasetSchema:
    return parse_schema(Path(path).read_text(encoding="utf-8"))


class Registry:
    """All schemas of a folder, checked at once."""

    def __init__(self, schemas: dict[str, DatasetSchema]):
        self.schemas = schemas

    @classmethod
    def load(cls, folder: str | Path) -> Registry:
        found: dict[str, DatasetSchema] = {}
        for p in sorted(Path(folder).glob("*.yaml")):
            s = load_schema(p)
            if s.name in found:
                raise SchemaError(f"{p}: dataset {s.name} is declared twice")
            found[s.name] = s
        return cls(found)

    def datasets(self) -> list[str]:
        return sorted(self.schemas)

    def schema(self, name: str) -> DatasetSchema:
        if name not in self.schemas:
            raise ConfigError(f"unknown dataset {name!r}")
        return self.schemas[name]

    def collecting(self) -> list[str]:
        return [n for n in self.datasets() if "collector" in self.schemas[n].raw]

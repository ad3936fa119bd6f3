"""Revisions, history and the ingestion fold.

Three ways, by what the dataset's derived fields look back on:
  none      hashes compared by lag() and a running sum: one window, all native;
  ordered   every key once and arrival in (effective_at, key) order: ROWS frames, all native;
  general   a fold over each dataset and scope in arrival order, exact decimals, in Python over Arrow.
"""

from __future__ import annotations

import bisect
import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.canon import NULL_I64, canonical_json, decimal_text
from ..runtime import arrow_batch
from ..sources.schema import DatasetSchema


def assign_revisions(rows: DataFrame, by: list[str], order: list[str], payload: Column, prior: DataFrame | None = None) -> DataFrame:
    """Keeps the rows whose payload differs from the one before of the same key, numbered from 1.

    A -> B -> A makes three revisions. prior: (by..., revision, payload_hash) of what the store already has.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("payload_hash", F.sha2(payload, 256))
    base, first = F.lit(0), F.lit(None).cast("string")
    if prior is not None:
        known = prior.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("revision").alias("_base"), F.col("payload_hash").alias("_first"))
        out = out.join(known, [F.col(c) == F.col(f"_{c}") for c in by], "left").drop(*[f"_{c}" for c in by])
        base, first = F.coalesce("_base", F.lit(0)), F.col("_first")
    changed = ~F.coalesce(F.lag("payload_hash").over(w), first).eqNullSafe(F.col("payload_hash"))
    out = out.withColumn("_new", changed.cast("int")).withColumn("revision", (base + F.sum("_new").over(w)).cast("int"))
    return out.where("_new = 1").drop("_new", "_base", "_first")


def latest_state(journal: DataFrame) -> DataFrame:
    """(dataset, key, revision, payload_hash): the highest revision of each key, whatever the order of replay."""
    top = F.max_by(F.struct("revision", F.sha2("fields", 256).alias("payload_hash")), "revision").alias("s")
    return journal.groupBy("dataset", "key").agg(top).select("dataset", "key", "s.revision", "s.payload_hash")


def ordered_frames(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def with_derived(rows: DataFrame, schema_order: list[tuple[str, str]], by: list[str], order: list[str]) -> DataFrame:
    """Adds derived columns in dependency order, a layer each (W08); native frames."""
    for name, text in schema_order:
        fields = {c: F.col(c) for c in rows.columns}
        tree = expr.parse(text)
        rows = rows.withColumn(name, expr.to_column(tree, ordered_frames(by, order) if tree.lookback() else None, fields))
    return rows


def history_before(facts: DataFrame, limit: int) -> DataFrame:
    """For each row, the `limit` facts before it in (effective_at, key), each at its latest revision known by then.

    facts: scope, seq, key, effective_at, value. Quadratic in a scope: for verification and small scopes.
    """
    c, h = facts.alias("c"), facts.alias("h")
    past = c.join(h, (F.col("c.scope") == F.col("h.scope")) & (F.col("h.seq") < F.col("c.seq")) & (F.col("h.key") != F.col("c.key")))
    per_key = past.groupBy(F.col("c.scope").alias("scope"), F.col("c.seq").alias("seq"), F.col("c.effective_at").alias("at"), F.col("c.key").alias("key"), F.col("h.key").alias("hk")).agg(
        F.max_by("h.effective_at", "h.seq").alias("he"), F.max_by("h.value", "h.seq").alias("hv")
    )
    before = per_key.where((F.col("he") < F.col("at")) | ((F.col("he") == F.col("at")) & (F.col("hk") < F.col("key"))))
    w = Window.partitionBy("scope", "seq").orderBy(F.desc("he"), F.desc("hk"))
    return before.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).groupBy("scope", "seq").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("hv").alias("v")))).alias("history"))


class History:
    """A scope's facts by (effective_at, key), each key once, the latest revision.

    The order is kept in blocks, so a step costs no more in a scope of many keys. A fact without a time is first.
    """

    BLOCK = 1000

    def __init__(self):
        self.blocks: list[list[tuple[int, str]]] = [[]]
        self.lows: list[tuple[int, str]] = [(NULL_I64, "")]
        self.facts: dict[str, tuple[int, object]] = {}

    def _block(self, item: tuple[int, str]) -> int:
        return max(0, bisect.bisect_right(self.lows, item) - 1)

    def upsert(self, effective_at: int | None, key: str, payload) -> None:
        at = NULL_I64 if effective_at is None else effective_at
        if key in self.facts:
            old = self.facts[key][0], key
            b = self._block(old)
            del self.blocks[b][bisect.bisect_left(self.blocks[b], old)]
            if not self.blocks[b] and b:
                del self.blocks[b], self.lows[b]
        b = self._block((at, key))
        block = self.blocks[b]
        bisect.insort(block, (at, key))
        if len(block) > 2 * self.BLOCK:
            self.blocks[b : b + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            self.lows.insert(b + 1, block[self.BLOCK])
        self.facts[key] = at, payload

    def before(self, effective_at: int | None, key: str, limit: int) -> list:
        """The last `limit` facts strictly before, without the key itself, oldest first."""
        item = (NULL_I64 if effective_at is None else effective_at), key
        b, picked = self._block(item), []
        end = bisect.bisect_left(self.blocks[b], item)
        while b >= 0 and len(picked) < limit:
            for k in range(end - 1, -1, -1):
                if len(picked) == limit:
                    break
                if self.blocks[b][k][1] != key:
                    picked.append(self.facts[self.blocks[b][k][1]][1])
            b -= 1
            end = len(self.blocks[b])
        return picked[::-1]

    def payloads(self) -> list:
        return [self.facts[k][1] for block in self.blocks for _, k in block]


def build_key(schema: DatasetSchema, row: dict, fields: dict) -> str:
    """The identity of a fact, `|`-joined in the schema's order."""
    import datetime as dt

    def day(ms):
        return dt.datetime.fromtimestamp(ms // 1000, dt.timezone.utc).strftime("%Y-%m-%d")

    parts = []
    for name in schema.key:
        if name == "effective_at":
            ms = row["effective_at"]
            parts.append(f"{day(ms)}T{ms}")
        elif name in ("period_start", "period_end"):
            parts.append("-" if pd.isna(row[name]) else day(int(row[name])))
        elif name == "title":
            parts.append(str(row.get("title") or fields.get("title") or ""))
        elif name == "scope":
            parts.append(row["scope"])
        else:
            parts.append("" if fields.get(name) is None else str(fields[name]))
    return "|".join(parts)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


class Fold:
    """The state of one dataset (or dataset and scope): revisions by key, history by scope.

    A key costs its text, a revision, 32 bytes of digest and the values that derived fields read.
    """

    def __init__(self, schema: DatasetSchema, now_ms: int, live: bool, skew_ms: int = 5_000, max_age_ms: int | None = None):
        self.schema, self.now, self.live, self.skew, self.max_age = schema, now_ms, live, skew_ms, max_age_ms
        self.trees = [(n, expr.parse(schema.fields[n].derived)) for n in schema.derived_order]
        self.depth = max([t.lookback() for _, t in self.trees], default=0)
        self.read = sorted(frozenset().union(*[t.names() for _, t in self.trees]))
        self.state: dict[str, tuple[int, bytes]] = {}
        self.history: dict[str, History] = {}

    def keep(self, scope: str, key: str, effective_at: int, revision: int, digest: bytes, fields: dict) -> None:
        self.state[key] = revision, digest
        if self.depth:
            self.history.setdefault(scope, History()).upsert(effective_at, key, tuple(fields.get(n) for n in self.read))

    def load(self, scope: str, key: str, effective_at: int, revision: int, fields: dict) -> None:
        if key not in self.state or revision > self.state[key][0]:
            self.keep(scope, key, effective_at, revision, _digest(canonical_json(fields)), fields)

    def derive(self, row: dict, key: str, fields: dict) -> dict:
        have = self.history.get(row["scope"]) if self.depth else None
        past = [dict(zip(self.read, p)) for p in have.before(row["effective_at"], key, self.depth)] if have else []
        seen = {**fields, "known_at": row["known_at"], "effective_at": row["effective_at"]}
        for name, tree in self.trees:
            value = expr.evaluate(tree, seen, past)
            if value is not None and self.schema.overflow == "round_half_even_8":
                value = round(value, 8)
            fields[name] = seen[name] = None if value is None else decimal_text(value)
        return fields

    def step(self, row: dict) -> dict:
        """One candidate in arrival order -> outcome written, duplicate or quarantined, with key, revision and fields."""
        out = {"outcome": "quarantined", "reason": None, "key": "", "revision": 0, "fields": row["fields"]}
        if row["parse_error"]:
            return out | {"reason": row["parse_error"]}
        if row["known_at"] is not None and row["known_at"] > self.now + self.skew:
            return out | {"reason": "known_at lies in the future"}
        fields = json.loads(row["fields"])
        key = build_key(self.schema, row, fields)
        out["key"] = key
        try:
            fields = self.schema.checked(self.derive(row, key, fields))
        except ValueError as e:
            return out | {"reason": str(e)}
        text = canonical_json(fields)
        digest = _digest(text)
        before = self.state.get(key)
        same = before is not None and before[1] == digest
        if self.live and self.max_age is not None and row["effective_at"] is not None and row["effective_at"] < self.now - self.max_age and not same:
            return out | {"reason": "too old to have been observed live"}
        if same:
            return out | {"outcome": "duplicate", "revision": before[0], "fields": text}
        revision = (before[0] if before else 0) + 1
        self.keep(row["scope"], key, row["effective_at"], revision, digest, fields)
        return out | {"outcome": "written", "revision": revision, "fields": text}


FOLDED = "scope string, effective_at long, known_at long, period_start long, period_end long, availability string, title string, arrival long, outcome string, reason string, key string, revision int, fields string"

CARRIED = ("scope", "effective_at", "known_at", "period_start", "period_end", "availability", "title", "arrival")


def folded(schema: DatasetSchema, now_ms: int, live: bool = False, max_age_ms: int | None = None):
    """A function from batches of rows, by g and in arrival order, to batches of FOLDED: one batch and one group's Fold are held."""
    names = [f.split()[0] for f in FOLDED.split(", ")]

    def fold(batches):
        state, g = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if state is None or r["g"] != g:
                    state, g = Fold(schema, now_ms, live, max_age_ms=max_age_ms), r["g"]
                if r["stored"]:
                    state.load(r["scope"], r["key"], r["effective_at"], r["revision"], json.loads(r["fields"]))
                else:
                    done = {c: r[c] for c in CARRIED} | state.step(r)
                    out.append(tuple(done[n] for n in names))
            if out:
                yield arrow_batch(out, FOLDED)

    return fold


def ingest(candidates: DataFrame, schema: DatasetSchema, now_ms: int, live: bool = False, max_age_ms: int | None = None, journal: DataFrame | None = None) -> DataFrame:
    """Candidates (with `arrival`) -> outcome rows, by the general fold.

    Grouped by scope where the key holds the scope, else by the dataset as a whole, as keys then cross scopes.
    Arrival ties are settled by (known_at, effective_at) and the row's text. A task sorts its groups (on disk, where
    they are large) and folds them row by row: it holds what Fold keeps of each key of one group, not the rows.
    Of the journal a fold meets one row a key, its latest revision, and only the groups that have candidates.
    """
    by_scope = "scope" in schema.key
    group = F.col("scope") if by_scope else F.lit(schema.name)
    rows = candidates.withColumn("g", group).withColumn("stored", F.lit(False)).withColumn("key", F.lit("")).withColumn("revision", F.lit(0))
    if journal is not None:
        top = F.max_by(F.struct("seq", "revision", "known_at", "effective_at", "period_start", "period_end", "availability", "fields"), "revision").alias("s")
        kept = journal.where(F.col("dataset") == schema.name).withColumn("g", group).join(rows.select("g").distinct(), "g", "left_semi")
        kept = kept.groupBy("g", "scope", "key").agg(top).select("g", "scope", "key", "s.*").withColumnRenamed("seq", "arrival")
        kept = kept.withColumn("stored", F.lit(True)).withColumn("title", F.lit(None).cast("string")).withColumn("parse_error", F.lit(None).cast("string"))
        rows = rows.unionByName(kept.select(*rows.columns))

    order = [F.desc("stored"), *[F.asc_nulls_last(c) for c in ("arrival", "known_at", "effective_at", "scope", "title", "fields")]]
    return rows.repartition("g").sortWithinPartitions("g", *order).mapInArrow(folded(schema, now_ms, live, max_age_ms), FOLDED)

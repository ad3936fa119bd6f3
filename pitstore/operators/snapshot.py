"""Month windows: compile, dictionaries, hashes, verification, the binary form."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canon import NULL_I64, canonical_json, decimal_text, month_bounds, utc_month
from ..model import AVAILABILITY, CANONICAL_ORDER, StoreError
from ..runtime import arrow_batch, placed, stored
from ..sources.schema import DatasetSchema, parse_schema

# Fixed values of the binary form.
MAGIC, VERSION, SCALE = b"QKH1", 1, 8
TYPE_CODES = {"number": 0, "bool": 1, "timestamp": 2, "enum": 3}
DICTIONARIES = ("scope", "key", "source", "source_version", "parser", "raw_ref")
LONGS = ("known_at", "effective_at", "period_start", "period_end")


def months(journal: DataFrame) -> DataFrame:
    """month, records, last_seq and the month's inclusive bounds."""
    out = journal.groupBy(utc_month(F.col("known_at")).alias("month")).agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq"))
    low, high = month_bounds(F.col("month"))
    return out.select("month", "records", "last_seq", low.alias("from_ms"), high.alias("to_ms"))


def reusable(journal: DataFrame, compiled: DataFrame, last_seq: int) -> DataFrame:
    """month, records, reuse: before the first month with a newer row, and with as many rows as when compiled."""
    now = journal.groupBy(utc_month(F.col("known_at")).alias("month")).agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("top"))
    first = now.where(F.col("top") > last_seq).agg(F.min("month").alias("first"))
    was = compiled.select(F.col("month").alias("m"), F.col("records").alias("was"))
    out = now.join(was, F.col("month") == F.col("m"), "left").crossJoin(F.broadcast(first))  # one row
    return out.select("month", "records", F.coalesce((F.col("month") < F.coalesce("first", F.lit("9999-99"))) & (F.col("records") == F.col("was")), F.lit(False)).alias("reuse"))


def window_hashes(rows: DataFrame, by: str = "window") -> DataFrame:
    """A hash of each window's record ids, whatever their order or partitioning: no window is gathered to be hashed."""
    h = [F.sum(F.conv(F.substring(F.sha2("id", 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(2)]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), *h), 256).alias("hash"))


def compare(manifest: DataFrame, actual: DataFrame, by: str = "window") -> DataFrame:
    """Windows that are missing, unknown or other than the manifest says."""
    m, a = manifest.select(F.col(by).alias("_m"), F.col("hash").alias("_mh")), actual.select(F.col(by).alias("_a"), F.col("hash").alias("_ah"))
    out = m.join(a, F.col("_m") == F.col("_a"), "full")
    problem = F.when(F.col("_ah").isNull(), "window is missing").when(F.col("_mh").isNull(), "window is not in the manifest").when(F.col("_mh") != F.col("_ah"), "content differs")
    return out.select(F.coalesce("_m", "_a").alias(by), problem.alias("problem")).where(F.col("problem").isNotNull())


def with_index(rows: DataFrame, column: str) -> DataFrame:
    """Adds <column>_idx, the place of the value among the sorted distinct ones.

    Distinct values are numbered by range: no task holds all.
    """
    values = placed(rows.select(F.col(column).alias("_v")).where("_v is not null").distinct(), "_v", "_i")
    return rows.join(values.select("_v", F.col("_i").cast("int").alias("_i")), F.col(column) == F.col("_v")).drop("_v").withColumnRenamed("_i", f"{column}_idx")


def raw_refs(journal: DataFrame) -> DataFrame:
    return journal.groupBy(utc_month(F.col("known_at")).alias("month")).agg(F.array_sort(F.collect_set("raw_ref")).alias("raw_deps"))


def write_windows(journal: DataFrame, path: str, changed: list[str] | None = None) -> None:
    """Parquet by month, rows in canonical order; with `changed` only these months are replaced."""
    rows = journal.withColumn("month", utc_month(F.col("known_at")))
    if changed is not None:
        rows = rows.where(F.col("month").isin(*changed)) if changed else rows.where(F.lit(False))
    out = rows.repartition("month", F.pmod(F.floor(F.col("known_at") / 86_400_000), F.lit(31))).sortWithinPartitions("month", *CANONICAL_ORDER)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "month").parquet(path)


def verify_store(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Read only: recomputes every window's hash and compares."""
    return compare(manifest, window_hashes(spark.read.parquet(path).withColumn("window", F.col("month"))))


# --- the binary form ----------------------------------------------------------------------------------------


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<i", len(raw)) + raw


def _fixed(kind: str, v) -> int:
    from decimal import Decimal

    if v is None:
        return NULL_I64
    return int(Decimal(str(v)).scaleb(SCALE)) if kind == "number" else int(v)


def encode(schema: DatasetSchema, rows: list[dict]) -> bytes:
    """One window: header, field table, six sorted dictionaries, contiguous columns, sha256 trailer."""
    if any(r["dataset"] != schema.name for r in rows):
        raise StoreError(f"rows of another dataset than {schema.name}")
    rows = sorted(rows, key=lambda r: tuple(r[c] for c in CANONICAL_ORDER))
    payload = [json.loads(r["fields"]) for r in rows]
    kept = schema.storable_fields()
    out = [MAGIC, struct.pack("<i", VERSION), bytes.fromhex(schema.hash()), _text(schema.name), struct.pack("<iii", len(rows), len(kept), SCALE)]
    out += [_text(f.name) + struct.pack("<B", TYPE_CODES[f.type]) + _text(f.unit) for f in kept]
    places = {}
    for d in DICTIONARIES:
        values = sorted({r[d] for r in rows if r[d] is not None})
        places[d] = {v: k for k, v in enumerate(values)}
        out += [struct.pack("<i", len(values)), *map(_text, values)]
    for c in LONGS:
        out.append(np.array([NULL_I64 if r[c] is None else r[c] for r in rows], "<i8").tobytes())
    index = lambda c: np.array([places[c].get(r[c], -1) for r in rows], "<i4").tobytes()
    out += [index("scope"), index("key"), np.array([r["revision"] for r in rows], "<i4").tobytes(), np.array([AVAILABILITY.index(r["availability"]) for r in rows], "u1").tobytes()]
    out += [np.array([r["seq"] for r in rows], "<i8").tobytes(), *map(index, DICTIONARIES[2:])]
    out += [np.array([_fixed(f.type, p.get(f.name)) for p in payload], "<i8").tobytes() for f in kept]
    body = b"".join(out)
    return body + hashlib.sha256(body).digest()


def decode(data: bytes) -> tuple[dict, list[dict]]:
    """(header, rows); any overrun, wrong magic, version or trailer is a StoreError."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(data) - 32:
            raise StoreError("snapshot ends too soon")
        at += n
        return data[at - n : at]

    def number() -> int:
        return struct.unpack("<i", take(4))[0]

    def text() -> str:
        return take(number()).decode()

    if len(data) < 36 or data[:4] != MAGIC:
        raise StoreError("not a snapshot")
    if hashlib.sha256(data[:-32]).digest() != data[-32:]:
        raise StoreError("snapshot is damaged")
    take(4)
    if number() != VERSION:
        raise StoreError("unknown snapshot version")
    header = {"schema_hash": take(32).hex(), "dataset": text(), "records": number()}
    count, header["scale"] = number(), number()
    header["fields"] = [(text(), take(1)[0], text()) for _ in range(count)]
    words = {d: [text() for _ in range(number())] for d in DICTIONARIES}
    n = header["records"]
    column = lambda kind: np.frombuffer(take(np.dtype(kind).itemsize * n), kind)
    longs = {c: column("<i8") for c in LONGS}
    places = {"scope": column("<i4"), "key": column("<i4")}
    revision, availability, seq = column("<i4"), column("u1"), column("<i8")
    places |= {d: column("<i4") for d in DICTIONARIES[2:]}
    values = [column("<i8") for _ in header["fields"]]
    if at != len(data) - 32:
        raise StoreError("snapshot is longer than it says")
    from decimal import Decimal

    def value(code: int, v: int):
        if v == NULL_I64:
            return None
        return decimal_text(Decimal(int(v)).scaleb(-header["scale"])) if code == 0 else bool(v) if code == 1 else int(v)

    rows = []
    for k in range(n):
        r = {"dataset": header["dataset"], "revision": int(revision[k]), "availability": AVAILABILITY[availability[k]], "seq": int(seq[k])}
        r |= {c: None if longs[c][k] == NULL_I64 else int(longs[c][k]) for c in LONGS}
        r |= {d: None if p[k] < 0 else words[d][p[k]] for d, p in places.items()}
        r["fields"] = canonical_json({name: value(code, v[k]) for (name, code, _), v in zip(header["fields"], values)})
        rows.append(r)
    return header, rows


# --- the binary form of windows of any size -----------------------------------------------------------------

# A window may outgrow a task's memory and the 2 GB that one value can hold, so it is made as pieces.
PIECE_ROWS, PIECE_BYTES, BLOCK = 1024, 8192, 16_384
#: Dictionaries of up to so many bytes are broadcast to the rows; larger ones are joined.
SMALL_DICTIONARY = 8 << 20
PIECE = "month string, section int, at long, part int, items long, content binary"
SEALED = "month string, records long, sha256 string, trailer binary"


def _columns(schema: DatasetSchema) -> list[tuple[str, str]]:
    """(column, kind) in the order of the file."""
    out = [(c, "<i8") for c in LONGS] + [("scope_idx", "<i4"), ("key_idx", "<i4"), ("revision", "<i4"), ("availability", "u1"), ("seq", "<i8")]
    return out + [(f"{d}_idx", "<i4") for d in DICTIONARIES[2:]] + [(f.name, "<i8") for f in schema.storable_fields()]


def _cut(month, section: int, at: int, items: int, data: bytes) -> list[tuple]:
    """data as parts of at most PIECE_BYTES; the last one counts the items."""
    return [(month, section, at, k, items if o + PIECE_BYTES >= len(data) else 0, data[o : o + PIECE_BYTES]) for k, o in enumerate(range(0, len(data), PIECE_BYTES))]


def _heads(schema: DatasetSchema):
    """Rows of (month, records, a count for each dictionary) -> the header's piece and those of the counts."""

    def one(batches):
        kept = schema.storable_fields()
        for b in batches:
            out = []
            for r in b.to_pylist():
                head = [MAGIC, struct.pack("<i", VERSION), bytes.fromhex(schema.hash()), _text(schema.name), struct.pack("<iii", r["records"], len(kept), SCALE)]
                head += [_text(f.name) + struct.pack("<B", TYPE_CODES[f.type]) + _text(f.unit) for f in kept]
                out.append((r["month"], 0, 0, 0, r["records"], b"".join(head)))
                out += [(r["month"], 1 + k, -1, 0, r[d], struct.pack("<i", r[d])) for k, d in enumerate(DICTIONARIES)]
            if out:
                yield arrow_batch(out, PIECE)

    return one


def _runs(months: list, places: list):
    """Stretches [a, b) of rows that follow each other in one month, cut where PIECE_ROWS begin."""
    a = 0
    for k in range(1, len(places) + 1):
        if k == len(places) or months[k] != months[a] or places[k] != places[k - 1] + 1 or places[k] % PIECE_ROWS == 0:
            yield a, k
            a = k


def _words(batches):
    """Sorted rows of (month, d, value, place) -> pieces of the dictionaries, each read back."""
    for b in batches:
        month, d, value, place = (b.column(k).to_pylist() for k in range(4))
        out = []
        for a, e in _runs(list(zip(month, d)), place):
            data, at = b"".join(map(_text, value[a:e])), 0
            for v in value[a:e]:
                n = struct.unpack_from("<i", data, at)[0]
                if data[at + 4 : at + 4 + n].decode() != v:
                    raise StoreError("a dictionary reads back otherwise")
                at += 4 + n
            out += _cut(month[a], 1 + d[a], place[a], e - a, data)
        if out:
            yield arrow_batch(out, PIECE)


def _values(schema: DatasetSchema):
    """Sorted rows with their place -> pieces of the columns, each read back."""

    def one(batches):
        kept, columns = schema.storable_fields(), _columns(schema)
        for b in batches:
            rows = {c: b.column(c).to_pylist() for c in b.schema.names}
            if any(x != schema.name for x in rows["dataset"]):
                raise StoreError(f"rows of another dataset than {schema.name}")
            payload = [json.loads(x) for x in rows.pop("fields")]
            rows |= {c: [NULL_I64 if x is None else x for x in rows[c]] for c in LONGS}
            rows["availability"] = [AVAILABILITY.index(x) for x in rows["availability"]]
            fields = {f.name: [_fixed(f.type, p.get(f.name)) for p in payload] for f in kept}
            out = []
            for a, e in _runs(rows["month"], rows["place"]):
                for k, (c, kind) in enumerate(columns):
                    want = (fields[c] if k >= len(columns) - len(kept) else rows[c])[a:e]
                    data = np.array(want, kind).tobytes()
                    if np.frombuffer(data, kind).tolist() != want:
                        raise StoreError(f"{c} reads back otherwise")
                    out += _cut(rows["month"][a], 1 + len(DICTIONARIES) + k, rows["place"][a], e - a, data)
            if out:
                yield arrow_batch(out, PIECE)

    return one


def pieces(journal: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Every month's window but for its trailer, as pieces in the order of (section, at, part): header, dictionaries, columns.

    journal has `month`. Rows are numbered in canonical order by range, dictionary values too; no task holds a window.
    """
    order = [*CANONICAL_ORDER, *[c for c in (*LONGS, "availability", *DICTIONARIES, "fields") if c not in CANONICAL_ORDER]]
    rows = stored(journal.select("month", "dataset", *order), "window-rows")
    values = rows.select("month", F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.col(c).alias("value")) for k, c in enumerate(DICTIONARIES)])).alias("v"))
    words = stored(placed(values.select("month", "v.*").where("value is not null").distinct(), "value", "place", ["month", "d"]).select("month", "d", "value", "place"), "window-words")
    sizes = {r["d"]: r["bytes"] for r in words.groupBy("d").agg(F.sum(F.octet_length("value") + 16).alias("bytes")).collect()}
    months = rows.groupBy("month").agg(F.count(F.lit(1)).alias("records"))
    counts = words.groupBy(F.col("month").alias("_m")).agg(*[F.count_if(F.col("d") == k).alias(c) for k, c in enumerate(DICTIONARIES)])
    heads = months.join(counts, F.col("month").eqNullSafe(F.col("_m")), "left").select("month", "records", *[F.coalesce(c, F.lit(0)).alias(c) for c in DICTIONARIES])

    full = placed(rows, order, "place", ["month"])
    for k, c in enumerate(DICTIONARIES):
        if k not in sizes:
            full = full.withColumn(f"{c}_idx", F.lit(-1))
            continue
        of = words.where(F.col("d") == k).select(F.col("month").alias("_m"), F.col("value").alias("_v"), F.col("place").cast("int").alias("_i"))
        of = F.broadcast(of) if sizes[k] <= SMALL_DICTIONARY else of
        full = full.join(of, F.col("month").eqNullSafe(F.col("_m")) & (F.col(c) == F.col("_v")), "left").withColumn(f"{c}_idx", F.coalesce("_i", F.lit(-1))).drop("_m", "_v", "_i")
    full = full.select("month", "place", "dataset", "fields", *[c for c, _ in _columns(schema)[: len(LONGS) + 5 + len(DICTIONARIES) - 2]])

    def dealt(df: DataFrame, by: list[str]) -> DataFrame:
        return df.repartition(*by, F.floor(F.col("place") / BLOCK)).sortWithinPartitions(*by, "place")

    out = heads.mapInArrow(_heads(schema), PIECE).unionByName(dealt(words, ["month", "d"]).mapInArrow(_words, PIECE))
    return out.unionByName(dealt(full, ["month"]).mapInArrow(_values(schema), PIECE))


def sealed(parts: DataFrame, schema: DatasetSchema) -> DataFrame:
    """(month, records, sha256, trailer): reads the pieces of each window in order, checks that none is missing, and hashes them.

    A SHA-256 is of one stream, so one task reads a window; it holds a batch of pieces.
    """
    widths = [np.dtype(kind).itemsize for _, kind in _columns(schema)]
    first = 1 + len(DICTIONARIES)

    def one(batches):
        month, h, records, section, items, due, next_part = None, None, 0, 0, 0, 0, 0

        def close():
            """Of one section: as many items as were announced."""
            if next_part or items != due:
                raise StoreError("snapshot ends too soon" if items < due else "snapshot is longer than it says")

        def end():
            close()
            if section != first + len(widths) - 1:
                raise StoreError("snapshot ends too soon")
            trailer = h.digest()
            h.update(trailer)
            return arrow_batch([(month, records, h.hexdigest(), trailer)], SEALED)

        for b in batches:
            for m, s, at, part, n, content in zip(*[c.to_pylist() for c in b.columns]):
                if h is None or (s, at, part) == (0, 0, 0):
                    if h is not None:
                        yield end()
                    if (s, at, part) != (0, 0, 0) or content[:4] != MAGIC:
                        raise StoreError("not a snapshot")
                    month, h, records, section, items, due, next_part = m, hashlib.sha256(), n, 0, 0, n, 0
                if m != month:
                    raise StoreError("not a snapshot")
                if s != section:
                    close()
                    if s != section + 1 or (s < first) != (at == -1):
                        raise StoreError("snapshot ends too soon")
                    section, items, due = s, 0, n if s < first else records
                if part != next_part or (at != -1 and at != items):
                    raise StoreError("snapshot ends too soon")
                if at == -1:
                    if struct.unpack("<i", content)[0] != n:
                        raise StoreError("snapshot is damaged")
                else:
                    if s >= first and len(content) != n * widths[s - first]:
                        raise StoreError("snapshot is damaged")
                    items, next_part = items + n, 0 if n else part + 1
                h.update(content)
        if h is not None:
            yield end()

    return parts.repartition("month").sortWithinPartitions("month", "section", "at", "part").mapInArrow(one, SEALED)


def encoded(journal: DataFrame, schema_text: str) -> DataFrame:
    """(month, records, sha256, trailer): every month's window, written as pieces to the shared folder and read back.

    A window's bytes are its pieces and the trailer, as encode() gives them.
    """
    schema = parse_schema(schema_text)
    return sealed(stored(pieces(journal, schema), "window-pieces"), schema)

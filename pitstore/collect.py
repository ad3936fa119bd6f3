"""From candidates to the store, for every way in: collected documents, backfills, streams."""

from __future__ import annotations

import os
import time
import urllib.request
from pathlib import Path
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.canon import utc_month
from .model import ConfigError
from .operators import aggregates, revise, snapshot
from .sources import code, declarative, journal, web
from .sources.schema import DatasetSchema, Registry


def stored_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """The journal, or None while the store is empty."""
    try:
        return journal.read(spark, os.path.join(root, "journal")).drop("day")
    except Exception as e:  # an empty store has no schema yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def into_store(candidates: DataFrame, schema: DatasetSchema, root: str, source: str, parser: str, live: bool = False, max_age_ms: int | None = None, version: str = "", raw_ref: str | None = None) -> dict:
    """Folds candidates (with `arrival`) against the journal, appends what is new, sets bad rows aside; the counts."""
    have = stored_rows(candidates.sparkSession, root)
    done = revise.ingest(candidates, schema, int(time.time() * 1000), live, max_age_ms, have).persist()
    try:
        counts = aggregates.outcomes(done).first().asDict()
        stamp = {"dataset": schema.name, "source": source, "source_version": version, "parser": parser, "raw_ref": raw_ref}
        rows = done.where("outcome = 'written'").select("scope", "key", "revision", "known_at", "effective_at", "availability", "fields", "period_start", "period_end", "arrival", *[F.lit(v).cast("string").alias(k) for k, v in stamp.items()])
        journal.append(journal.numbered(rows, have), os.path.join(root, "journal"))
        bad = done.where("outcome = 'quarantined'").select(F.lit(schema.name).alias("dataset"), "reason", F.col("fields").alias("payload"))
        journal.quarantine(bad, os.path.join(root, "quarantine"))
    finally:
        done.unpersist()
    return counts


def document_candidates(spark: SparkSession, path: str, c: declarative.Collector, now_ms: int) -> DataFrame:
    """Candidates of one landed document, in its own order."""
    if c.kind == "http_json":
        rows = declarative.json_rows(spark.read.format("binaryFile").load(path).select("content"), c.record_path)
    else:
        rows = declarative.csv_rows(spark, path).withColumn("ordinal", F.monotonically_increasing_id())
    out = declarative.candidates(rows, c, F.lit(now_ms), keep=("ordinal",)).withColumnRenamed("ordinal", "arrival")
    if c.known == "effective_at":
        out = out.withColumn("known_at", F.coalesce("effective_at", "known_at"))
    return out.withColumn("arrival", F.col("arrival").cast("long"))


def collect_once(spark: SparkSession, root: str, schema: DatasetSchema, opener: Callable = urllib.request.urlopen, timeout: float = 30.0, folder: str = ".") -> dict:
    """Fetches one dataset's document and stores what is new. The caller holds the writer's lock.

    root lies on a file system that the executors mount too, as documents are read from where they landed.
    Returns and records in status/<dataset>.json: ok, error, and the counts. A server that fails or has nothing
    new leaves the store as it is; an unchanged document is a success with no rows.
    """
    if "collector" not in schema.raw:
        raise ConfigError(f"{schema.name} has no collector")
    now = int(time.time() * 1000)
    if schema.raw["collector"].get("kind") == "code":
        source = code.load_source(schema.name, schema.raw["collector"], folder)
        rows = source.candidates(spark, now, timeout)
        out = {"at": now, "ok": rows is not None, "error": "nothing from the source" if rows is None else None, "written": 0}
        if rows is not None:
            out |= into_store(rows, schema, root, f"code/{schema.name}", source.parser, live=True, max_age_ms=source.max_age_ms)
        journal.replace_json(os.path.join(root, "status", f"{schema.name}.json"), out)
        return out
    c = declarative.load_collector(schema.name, schema.raw["collector"])
    found = web.fetch(root, schema.name, c.url, web.CONTENT[c.kind], c.headers, opener, timeout)
    out = {"at": now, "ok": found.problem in (None, "unchanged"), "error": found.problem, "written": 0}
    if found.problem is None:
        rows = document_candidates(spark, Path(found.path).absolute().as_uri(), c, now)
        out |= into_store(rows, schema, root, f"http/{schema.name}", c.parser, live=True, max_age_ms=c.max_age_ms, version=c.url, raw_ref=found.sha256)
        out |= {"raw_ref": found.sha256, "bytes": found.size}
        web.remember(root, schema.name)
    journal.replace_json(os.path.join(root, "status", f"{schema.name}.json"), out)
    return out


def compile_store(spark: SparkSession, root: str, registry: Registry) -> int:
    """Writes the journal's months as windows and names them, with the field tables, in the manifest; how many."""
    rows = journal.read(spark, os.path.join(root, "journal")).drop("day")
    old = journal.load_manifest(root)
    snapshot.write_windows(rows, os.path.join(root, "snapshot"))
    hashes = snapshot.window_hashes(rows.withColumn("window", F.concat_ws("|", "dataset", utc_month(F.col("known_at")))))
    found: dict[str, dict] = {}
    for r in hashes.toLocalIterator():
        dataset, month = r["window"].split("|")
        found.setdefault(dataset, {"windows": []})["windows"].append({"from": month, "records": r["records"], "sha256": r["hash"]})
    for r in journal.last_seq(rows).toLocalIterator():
        found[r["dataset"]]["last_seq"] = r["last_seq"]
    for dataset, doc in found.items():
        if dataset in registry.schemas:
            doc["fields"] = registry.schema(dataset).field_entries()
    journal.save_manifest(root, old["datasets"] | found)
    return sum(len(d["windows"]) for d in found.values())


def _interval(spark: SparkSession, root: str, schema: DatasetSchema, now: float) -> float:
    """Seconds to the next poll: the cadence, the nearer one while a stored event of the dataset is near."""
    block = schema.raw["collector"]
    if block.get("kind") == "code":
        return declarative.duration_seconds(block.get("cadence", 3600))
    every = declarative.load_collector(schema.name, block).cadence
    have = stored_rows(spark, root) if every.near is not None else None
    if have is None:
        return every.interval(now, [])
    at = F.col("effective_at") / 1000
    near = have.where((F.col("dataset") == schema.name) & (at - every.before <= now) & (at + every.after >= now)).limit(1).collect()
    return every.interval(now, [r["effective_at"] / 1000 for r in near])


def run(spark: SparkSession, registry: Registry, config: Config, once: bool = False, opener: Callable = urllib.request.urlopen, clock: Callable = time.time, sleep: Callable = time.sleep) -> list[str]:
    """Polls each collecting dataset when it is due and compiles now and then, until stopped.

    A failure holds up nobody else: it is recorded, counted and tried again after `retry_seconds`. The file
    `heartbeat` is touched at least every `heartbeat_seconds`. With `once` every dataset is polled one time; the
    names of those that failed are returned.
    """
    names, root = registry.collecting(), config.root
    due, failed = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
    compiled = None if config.compile["on_start"] else clock()
    with journal.writer_lock(root):
        while True:
            Path(root, "heartbeat").touch()
            for name in names:
                now = clock()
                if due[name] > now:
                    continue
                s = registry.schema(name)
                try:
                    out = collect_once(spark, root, s, opener, config.poll["timeout_seconds"], config.datasets_dir)
                    wait = _interval(spark, root, s, now) if out["ok"] else config.poll["retry_seconds"]
                except Exception as e:  # one source's trouble is its own
                    out, wait = {"at": int(now * 1000), "ok": False, "error": str(e)[:500], "written": 0}, config.poll["retry_seconds"]
                failed[name] = 0 if out["ok"] else failed[name] + 1
                alert = failed[name] >= config.poll["failures_before_alert"]
                journal.replace_json(os.path.join(root, "status", f"{name}.json"), out | {"consecutive_failures": failed[name], "alert": alert})
                due[name] = now + wait
                Path(root, "heartbeat").touch()
            if once:
                return [n for n in names if failed[n]]
            if stored_rows(spark, root) is not None and (compiled is None or clock() - compiled >= config.compile["every_seconds"]):
                compile_store(spark, root, registry)
                compiled = clock()
            sleep(max(0.0, min([config.poll["heartbeat_seconds"], *[t - clock() for t in due.values()]])))

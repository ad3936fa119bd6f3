"""Structured Streaming: continuous ingestion, keyed revision state, hourly windows with finality."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..collect import into_store
from ..operators.aggregates import HOUR, hour_end
from ..sources import journal
from ..sources.schema import DatasetSchema

REVISIONS = "dataset string, key string, seq long, revision int, fields string, payload_hash string"


def revisions(stream: DataFrame) -> DataFrame:
    """Keeps changes and numbers them, with one small state a key: (revision, hash). Late rows are kept, never dropped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, digest = state.get if state.exists else (0, "")
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if r.payload_hash != digest:
                revision, digest = revision + 1, r.payload_hash
                out.append((key[0], key[1], r.seq, revision, r.fields, digest))
        state.update((revision, digest))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REVISIONS.split(", ")])

    rows = stream.select("dataset", "key", "seq", "fields", F.sha2("fields", 256).alias("payload_hash"))
    return rows.groupBy("dataset", "key").applyInPandasWithState(step, REVISIONS, "revision int, digest string", "append", GroupStateTimeout.NoTimeout)


def into_journal(candidates: DataFrame, schema: DatasetSchema, root: str, checkpoint: str, live: bool = True, max_age_ms: int | None = None, once: bool = True, source: str = "stream", parser: str = "stream@1") -> StreamingQuery:
    """A stream of candidates, folded batch by batch into the store at `root`.

    The state is the journal itself, so a restart needs nothing but the checkpoint. A batch that is replayed
    after a crash meets its own rows as duplicates and adds none: seq and revisions stay as they were.
    """

    def one(batch: DataFrame, number: int) -> None:
        into_store(batch.withColumn("arrival", F.monotonically_increasing_id()), schema, root, source, parser, live, max_age_ms)

    writer = candidates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def hours(stream: DataFrame, wait: str = "45 minutes") -> DataFrame:
    """Counts by right-closed hour and region, emitted when the hour is final: 45 minutes past its end.

    stream: stamp (ms), region. Shifting a stamp by a millisecond makes the engine's left-closed window fit.
    """
    at = F.timestamp_millis(hour_end(F.col("stamp")) - HOUR)
    timed = stream.withColumn("at", at).withWatermark("at", wait)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "region").agg(F.count(F.lit(1)).alias("events")).select((F.unix_millis(F.col("w.start")) + HOUR).alias("hour"), "region", "events")


class Heartbeat(StreamingQueryListener):
    """Touches a file on every progress; its age is the liveness of the engine."""

    def __init__(self, path: str):
        self.path = path

    def _beat(self):
        with open(self.path, "a"):
            os.utime(self.path)

    def onQueryStarted(self, event):
        self._beat()

    def onQueryProgress(self, event):
        self._beat()

    def onQueryIdle(self, event):
        self._beat()

    def onQueryTerminated(self, event):
        pass


def run_all(spark: SparkSession, start: dict[str, callable], root: str) -> dict[str, str]:
    """One query a source, each on its own: a failure is recorded and stops no other."""
    out = {}
    for name, f in start.items():
        path = os.path.join(root, "status", f"{name}.json")
        doc = journal.read_json(path)
        try:
            f(spark).awaitTermination()
            doc |= {"ok": True, "error": None, "last_success_at": int(time.time() * 1000), "consecutive_failures": 0}
        except Exception as e:
            doc |= {"ok": False, "error": str(e)[:500], "consecutive_failures": doc.get("consecutive_failures", 0) + 1}
        out[name] = "ok" if doc["ok"] else doc["error"]
        journal.replace_json(path, doc | {"at": int(time.time() * 1000), "runs": doc.get("runs", 0) + 1})
    return out

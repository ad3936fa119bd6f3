"""Mixture-controlled packing by deficit round-robin over source queues (operator 6).

Every window of `window` sequences takes tokens from each source's queue in the target proportions. What a
source is short of its exact share stays as its deficit and is paid in a later window. The round-robin gives each
next token to the queue that is furthest behind, the one with the least (k + 1/2) / weight for its next token k;
a queue that runs dry leaves its share to the others. Its counters after n tokens depend on n alone, so no
partition runs the rounds before its own: it computes the counters at its first window, deficits included,
and goes on from there. Thus deficits carry over between partitions that do not wait for each other, and no
queue is sorted or gathered. The tests hold the counters against the rounds run one token at a time.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import bounded_batches, stored

#: Tables of at most this many rows (partitions x sources, sources) go to the executors whole.
SMALL = 100_000


def served(n: int, totals: list[int], weights: list[int]) -> list[int]:
    """Tokens that each queue has given when n tokens are out: each within one token of its share until it is dry."""
    live = [s for s, t in enumerate(totals) if t and weights[s] > 0]
    got, left, pool = [0] * len(totals), min(n, sum(totals[s] for s in live)), list(live)
    while pool:  # dry queues first: the point in the order where n tokens are out
        total = sum(weights[s] for s in pool)
        dry = [s for s in pool if totals[s] * total <= left * weights[s]]
        if not dry:
            for s in pool:
                got[s] = min(totals[s], (2 * left * weights[s] + total) // (2 * total))
            break
        for s in dry:
            got[s] = totals[s]
            left -= totals[s]
        pool = [s for s in pool if s not in dry]
    over = sum(got) - min(n, sum(totals[s] for s in live))

    def before(a, b):  # the key (2k + 1) / weight of one token against another's; ties to the smaller source
        return (a[0] * weights[b[1]], a[1]) < (b[0] * weights[a[1]], b[1])

    def last():
        best = None
        for s in live:
            if got[s] and (best is None or before(best, (2 * got[s] - 1, s))):
                best = (2 * got[s] - 1, s)
        return best

    def following():
        best = None
        for s in live:
            if got[s] < totals[s] and (best is None or before((2 * got[s] + 1, s), best)):
                best = (2 * got[s] + 1, s)
        return best

    while over > 0:
        got[last()[1]] -= 1
        over -= 1
    while over < 0:
        got[following()[1]] += 1
        over += 1
    while (a := last()) and (b := following()) and before(b, a):
        got[a[1]] -= 1
        got[b[1]] += 1
    # queues without a weight follow when all others are dry
    rest = n - sum(got)
    for s, t in enumerate(totals):
        if s not in live and rest > 0:
            got[s] = min(t, rest)
            rest -= got[s]
    return got


class Windows:
    """Where the window w's share of each source lies, in the source's queue and in the packed stream."""

    def __init__(self, totals: list[int], weights: list[int], tokens: int):
        self.totals, self.weights, self.tokens, self.all = totals, weights, tokens, sum(totals)
        self.known: dict[int, list[int]] = {}

    def upto(self, w: int) -> list[int]:
        """Tokens of each source in the first w windows."""
        if w not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            self.known[w] = served(min(w * self.tokens, self.all), self.totals, self.weights)
        return self.known[w]

    def deficit(self, w: int, source: int) -> float:
        """Tokens that the source is short of its exact share when window w is full; below zero: ahead of it.

        The exact share is that of the queues which still have tokens then; a dry queue is owed nothing.
        """
        got = self.upto(w + 1)
        live = [s for s, t in enumerate(self.totals) if got[s] < t and self.weights[s] > 0]
        if source not in live:
            return 0.0
        all_weights = sum(self.weights[s] for s in live)
        return sum(got[s] for s in live) * self.weights[source] / all_weights - got[source]

    def holding(self, source: int, at: int) -> int:
        """The window that holds the source's token number `at`."""
        low, high = 0, -(-self.all // self.tokens)
        while high - low > 1:
            mid = (low + high) // 2
            if self.upto(mid)[source] <= at:
                low = mid
            else:
                high = mid
        return low


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, window: int = 64, weights: dict[str, float] | None = None, temper: float = 1.0, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Packs every document (its ids, then `end_id`) into sequences of `length` tokens, cut freely.

    weights: target token proportions by source; None takes the sources' own shares to the power `temper`: 1 keeps
    them in every window to the end, less favours the small until they run dry. Sources without a weight are
    packed after the others. Only the very last sequence can be short (it is to be padded). Returns a row per
    piece: id, source, start, length, ids_crc32 (of the little-endian unsigned 32-bit ids), ids (binary),
    doc_tokens, sequence_id, offset, window_id, deficit (of the source, in tokens, when the window is full).

    Null or empty text gives the end id alone; a null source is a source of its own; null ids, ties and
    repeated rows are packed as they are; an empty table gives no rows; other columns are not read.
    The ids are made once and written to the shared folder; a hot source is spread over all partitions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenise(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            sources = b.column(2).to_pylist()
            ids = [enc.ids(t) + end for t in b.column(1).to_pylist()]
            n, at = [len(x) // 4 for x in ids], []
            for s, k in zip(sources, n):
                at.append(seen.get(s, 0))
                seen[s] = at[-1] + k
            small = [np.frombuffer(x, "<u4") for x in ids]
            narrow = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else raw for x, raw in zip(small, ids)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(narrow, pa.binary())],
                names=["id", "source", "part", "at", "n", "ids"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].cast("string").alias("source"))
    made = stored(rows.mapInArrow(tokenise, f"id {kind}, source string, part int, at long, n long, ids binary"), "packing-ids")

    parts = made.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    base = stored(parts.withColumn("base", F.sum("tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("source", "part", "tokens", F.coalesce("base", F.lit(0)).alias("base")), "packing-bases")
    by_source = base.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    totals = sorted(((r["source"], r["tokens"]) for r in by_source.toLocalIterator()), key=lambda x: (x[0] is not None, x[0] or ""))
    names = {s: k for k, (s, _) in enumerate(totals)}
    counts = [n for _, n in totals]
    if weights is None:
        shares = counts if temper == 1 else [max(1, round(1_000_000 * n**temper / max(counts) ** temper)) for n in counts]
    else:
        shares = [round(1_000_000 * weights.get(s, 0)) for s, _ in totals]
    lookup = base.select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    if base.count() <= SMALL:
        lookup = F.broadcast(lookup)
    placed = made.join(lookup, made["source"].eqNullSafe(F.col("s")) & (made["part"] == F.col("p"))).select("id", "source", (F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def cut(batches):
        grid = Windows(counts, shares, window * length)
        owed = lru_cache(100_000)(grid.deficit)
        held = 0
        for b in batches:
            cols: list[list] = [[] for _ in range(11)]
            for k, (i, s, at, n, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
                ids = (np.frombuffer(raw, "<u2").astype("<u4") if len(raw) == 2 * n else np.frombuffer(raw, "<u4")).tobytes()
                src, start = names[s], 0
                w = held if grid.upto(held)[src] <= at < grid.upto(held + 1)[src] else grid.holding(src, at)
                while start < n:
                    first, past = grid.upto(w), grid.upto(w + 1)
                    while past[src] <= at + start:
                        w += 1
                        first, past = past, grid.upto(w + 1)
                    here = sum(past[:src]) - sum(first[:src]) + at + start - first[src] + w * grid.tokens
                    size = min(n - start, past[src] - at - start, length - here % length)
                    x = ids[4 * start : 4 * (start + size)]
                    for c, v in zip(cols, (i, s, start, size, zlib.crc32(x), x, n, here // length, here % length, w, owed(w, src))):
                        c.append(v)
                    start += size
                held = w
            kinds = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "source", "start", "length", "ids_crc32", "ids", "doc_tokens", "sequence_id", "offset", "window_id", "deficit"])

    schema = f"id {kind}, source string, start long, length long, ids_crc32 long, ids binary, doc_tokens long, sequence_id long, offset long, window_id long, deficit double"
    return placed.mapInArrow(cut, schema).withColumnRenamed("id", id_col)

"""Suffix-array dedup: bytes under a string of `size` bytes that starts anywhere else go (operator 8).

A suffix array over the whole corpus would not fit any task, so texts are first cut down, without loss, to what
a repeated string can touch, and the suffix arrays are built over shards of that:

1. Every window of `size` bytes has an anchor, the place of its least gram hash; equal windows have equal
   anchors at equal offsets. Anchors whose hash stands once are done with. Windows of one anchor form a
   stretch; stretches that are equal as a whole are repeated as a whole.
2. Stretches that share an anchor but differ are cut into buckets of 32 starts. All windows of a bucket have a
   core of size - 31 bytes; cores that stand once are done with, equal buckets are repeated as a whole.
3. Buckets that share a core but differ form the shards' strings: up to 31 bytes, the core as one symbol, up to
   31 bytes. The suffix array by induced sorting and the permuted common prefixes tell which starts share 32
   symbols, hence `size` bytes, with a neighbour.

Equality: texts and cores are equal where 128 bits of hash are. Stretches are compared by 64 bits with the others
of their anchor only, buckets and counted windows with those of their core only, so n of them in one such group
give n * n / 2^65 wrong matches to be expected: one in 37 for a group of a thousand million different strings.
Most repeats of a corpus are copies of passages far longer than `size`; they are whole stretches and end in step
1. The suffix arrays decide where a passage begins and ends.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

GRAM, STARTS = 32, 32
PIECE = 1 << 22
#: Buckets with one core that one task sorts at most; the windows of more are counted, summed before the shuffle.
CROWD = 4096
#: Symbols in a shard, about.
SHARD = 400_000


# --- suffix arrays ----------------------------------------------------------------------------------------


def suffix_array(s: list[int], top: int) -> list[int]:
    """Suffix array of s (symbols 0..top) by induced sorting, linear in len(s) + top.

    Suffixes are classified as smaller (S) or larger (L) than the next; leftmost S ones (LMS) open substrings
    that are sorted by inducing from their first symbols, named, and sorted recursively where names repeat.
    """
    n = len(s)
    if n < 2:
        return list(range(n))
    small = bytearray(n)
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        small[i] = small[i + 1] if a == b else a < b
    sizes = [0] * (top + 2)
    for c in s:
        sizes[c + 1] += 1
    heads = sizes[:]
    for c in range(1, top + 2):
        heads[c] += heads[c - 1]
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induced(seeds: list[int]) -> list[int]:
        out = [-1] * n
        tail = heads[1:]
        for i in reversed(seeds):
            c = s[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = heads[:]
        last = n - 1  # the suffix before the end of the string is the first to be induced
        c = s[last]
        if not small[last]:
            out[head[c]] = last
            head[c] += 1
        for k in range(n):
            i = out[k] - 1
            if i >= 0 and not small[i]:
                c = s[i]
                out[head[c]] = i
                head[c] += 1
        tail = heads[1:]
        for k in range(n - 1, -1, -1):
            i = out[k] - 1
            if i >= 0 and small[i]:
                c = s[i]
                tail[c] -= 1
                out[tail[c]] = i
        return out

    if not lms:
        return induced([])
    order = induced(lms)
    ends = dict(zip(lms, [*lms[1:], n - 1]))
    names, name, before = {}, -1, None
    for i in order:
        if i not in ends:
            continue
        here = s[i : ends[i] + 1]
        if here != before or ends[i] == n - 1:
            name += 1
        names[i], before = name, here
    if name + 1 < len(lms):
        rank = suffix_array([names[i] for i in lms], name)
        seeds = [lms[k] for k in rank]
    else:
        seeds = sorted(lms, key=names.__getitem__)
    return induced(seeds)


def common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """plcp[i]: symbols that the suffix at i shares with the one before it in the array; in text order, linear."""
    n = len(s)
    before = [-1] * n
    for a, b in zip(sa, sa[1:]):
        before[b] = a
    out, k = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        while i + k < n and j + k < n and s[i + k] == s[j + k]:
            k += 1
        out[i] = k
        k = max(0, k - 1)
    return out


def repeated_starts(buckets: list[tuple[int, bytes, bytes, int]]) -> list[list[int]]:
    """For each bucket (core, bytes before, bytes after, starts): the starts whose window also stands in another one."""
    cores = {c: k for k, c in enumerate(sorted({b[0] for b in buckets}))}
    s, at, edge = [], [], []
    for core, left, right, _ in buckets:
        at.append(len(s))
        s += [x + 1 for x in left]
        s.append(257 + cores[core])
        s += [x + 1 for x in right]
        edge.append(len(s))
        s.append(0)  # a border; a match that runs over it is cut below
    sa = suffix_array(s, 257 + len(cores))
    plcp = common_prefixes(s, sa)
    both = plcp[:]  # the longer of the matches with both neighbours
    for a, b in zip(sa, sa[1:]):
        if plcp[b] > both[a]:
            both[a] = plcp[b]
    return [[x for x in range(n) if both[a + x] >= STARTS and a + x + STARTS <= e] for a, e, (_, _, _, n) in zip(at, edge, buckets)]


# --- anchors ----------------------------------------------------------------------------------------------

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 17), x, np.uint64)], dtype=np.uint64) for x in (base, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(raw) + 1)
    total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[1:], dtype=np.uint64)]
    h = (total[GRAM:] - total[:-GRAM]) * inverse[: len(raw) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(hash, anchor, first start, last start): the stretches of windows with one anchor; ties to the rightmost."""
    out = []
    for at in range(0, len(raw) - size + 1, PIECE):
        h = gram_hashes(np.frombuffer(raw[at : at + PIECE + size - 1], np.uint8))
        span = size - GRAM + 1
        low = np.uint64((1 << 24) - 1)
        v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        whole = np.full(-(-len(v) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        whole[: len(v)] = v
        grid = whole.reshape(-1, span)
        down = np.minimum.accumulate(grid, axis=1).ravel()
        up = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(v) - span + 1
        place = (low - (np.minimum(up[:n], down[span - 1 : span - 1 + n]) & low)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], n] - 1
        out += [(int(x), int(p) + at, int(a) + at, int(b) + at) for x, p, a, b in zip(h[place[first]].view(np.int64), place[first], first, last)]
    return out


# --- the operator -----------------------------------------------------------------------------------------


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _columns(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def repeated(docs: DataFrame, size: int = 400, text_col: str = "text") -> DataFrame:
    """(print, starts): for each different text that has some, the ranges of starts [a, b] of repeated windows."""
    import xxhash

    if size < GRAM + 2 * STARTS:
        raise ValueError(f"size must be {GRAM + 2 * STARTS} at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(docs[text_col].alias("t"))
    I8, I4, BIN = pa.int64(), pa.int32(), pa.binary()

    def find(batches):
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                raw = _bytes(t)
                if len(raw) >= size:
                    key = xxhash.xxh3_128_digest(raw)
                    rows += [(key, h, xxhash.xxh3_64_intdigest(raw[i : j + size], p - i) - (1 << 63), p, i, j) for h, p, i, j in anchors(raw, size)]
            yield _columns(rows, ["print", "h", "stretch", "p", "i", "j"], [BIN, I8, I8, I8, I8, I8])

    found = stored(texts.mapInArrow(find, "print binary, h long, stretch long, p long, i long, j long"), "anchors")
    kinds = found.groupBy("h", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("print", "p", "i", "j")).alias("at"))
    kinds = stored(kinds, "stretches")
    shared = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("all")).where("all > 1").select(F.col("h").alias("g"), "d")
    kinds = kinds.join(shared, F.col("h") == F.col("g"))
    # whole stretches: every place of those that stand twice
    twice = kinds.where("n > 1").select(F.col("h").alias("g"), F.col("stretch").alias("s"))
    whole = found.join(twice, (F.col("h") == F.col("g")) & (F.col("stretch") == F.col("s"))).select("print", F.col("i").alias("a"), F.col("j").alias("b"))
    # stretches with a like one: one place each, cut into buckets
    open_ = kinds.where("d > 1").select("at.print", F.struct("h", "at.p", "at.i", "at.j", (F.col("n") > 1).alias("done")).alias("x")).groupBy("print").agg(F.collect_list("x").alias("xs"))

    def printed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(_bytes(t)) for t in b.column(0).to_pylist()], BIN), b.column(0)], names=["key", "t"])

    named = texts.where(F.octet_length("t") >= size).mapInArrow(printed, "key binary, t string")
    joined = named.join(open_, F.col("key") == F.col("print")).select("print", "t", "xs")

    def cut(batches):
        core = size - STARTS + 1
        for b in batches:
            rows = []
            for key, t, xs in zip(*(c.to_pylist() for c in b.columns)):
                raw = _bytes(t)
                for x in xs:
                    h, p, i, j = x["h"], x["p"], x["i"], x["j"]
                    for k in range((p - j) // STARTS, (p - i) // STARTS + 1):
                        end = p - STARTS * k  # the last start of a whole bucket, where the core opens
                        a, z = max(i, end - STARTS + 1), min(j, end)
                        c = xxhash.xxh3_128_digest(raw[end : end + core], (h + k) & ((1 << 64) - 1))
                        like = xxhash.xxh3_64_intdigest(raw[a : z + size], end - a) - (1 << 63)
                        rows.append((c, like, key, a, z, x["done"], raw[a:end], raw[end + core : z + size]))
            yield _columns(rows, ["core", "alike", "print", "a", "b", "done", "left", "right"], [BIN if n in (0, 2, 6, 7) else pa.bool_() if n == 5 else I8 for n in range(8)])

    cuts = "core binary, alike long, print binary, a long, b long, done boolean, left binary, right binary"
    buckets = stored(joined.mapInArrow(cut, cuts), "buckets")
    light = buckets.select("core", "alike", "print", "a", "b", "done").distinct()  # texts that stand twice came twice
    like = light.groupBy("core", "alike").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("print", "a", "b")).alias("at"), F.min("done").alias("done"))
    like = stored(like, "alike")
    per_core = like.groupBy("core").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("all")).where("all > 1").select(F.col("core").alias("c"), "d")
    like = like.join(per_core, F.col("core") == F.col("c"))
    twice = like.where("n > 1").select(F.col("core").alias("c"), F.col("alike").alias("s"))
    some = light.where("not done").join(twice, (F.col("core") == F.col("c")) & (F.col("alike") == F.col("s"))).select("print", "a", "b")
    # buckets that share a core: suffix arrays
    mixed = like.where("d > 1").select(F.col("core").alias("c"), F.col("alike").alias("s"), "d", F.col("at.print").alias("q"), F.col("at.a").alias("qa"), ((F.col("n") > 1) | F.col("done")).alias("settled"))
    mine = (F.col("core") == F.col("c")) & (F.col("alike") == F.col("s")) & (F.col("print") == F.col("q")) & (F.col("a") == F.col("qa"))
    strings = stored(buckets.join(mixed, mine).select("core", "alike", "print", "a", "b", "settled", "d", "left", "right").dropDuplicates(["core", "alike"]), "strings")
    total = strings.agg(F.sum(F.length("left") + F.length("right") + 2)).first()[0] or 0
    shards = max(1, -(-total // SHARD))

    def sort_shard(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("core", "left", "right", "a", "b", "print", "settled"))))
        rows.sort(key=lambda r: (r[0], r[5], r[3]))
        out = []
        for (_, _, _, a, _, key, settled), starts in zip(rows, repeated_starts([(c, left, right, b - a + 1) for c, left, right, a, b, _, _ in rows])):
            if not settled:
                for _, run in groupby(enumerate(starts), key=lambda x: x[1] - x[0]):
                    run = list(run)
                    out.append((key, a + run[0][1], a + run[-1][1]))
        return pa.Table.from_batches([_columns(out, ["print", "a", "b"], [BIN, I8, I8])])

    ranges = "print binary, a long, b long"
    sorted_ = strings.where(F.col("d") <= CROWD).withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(shards))).groupBy("shard").applyInArrow(sort_shard, ranges)

    def windows(batches):
        for b in batches:
            rows = []
            for core, key, a, z, settled, left, right in zip(*(b.column(c).to_pylist() for c in ("core", "print", "a", "b", "settled", "left", "right"))):
                for x in range(z - a + 1):
                    w = left[x:] + b"\0" + right[: STARTS - 1 - (len(left) - x)]
                    rows.append((core, len(left) - x, xxhash.xxh3_64_intdigest(w) - (1 << 63), key, a + x, settled))
            yield _columns(rows, ["core", "o", "w", "print", "a", "settled"], [BIN, I4, I8, BIN, I8, pa.bool_()])

    crowd = strings.where(F.col("d") > CROWD).mapInArrow(windows, "core binary, o int, w long, print binary, a long, settled boolean")
    seen = crowd.groupBy(F.col("core").alias("c"), F.col("o").alias("oo"), F.col("w").alias("ww")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = crowd.where("not settled").join(seen, (F.col("core") == F.col("c")) & (F.col("o") == F.col("oo")) & (F.col("w") == F.col("ww"))).select("print", "a", F.col("a").alias("b"))
    every = whole.unionByName(some).unionByName(sorted_).unionByName(counted)
    return every.groupBy("print").agg(F.collect_set(F.struct("a", "b")).alias("starts"))


def remove_repeats(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every whole text as UTF-8 bytes, without each byte that is covered
    by a string of `size` bytes that also starts anywhere else, in the same text or another.

    Strings are judged on the input; overlaps count; matches never cross texts. All bytes under repeated
    strings go, the first occurrence too. Null text counts as empty; texts under `size` bytes stay; null ids and
    repeated rows stay (rows alike in text repeat each other); an empty table gives no rows; other columns are
    not read. kept is binary: a cut may fall inside a character.
    """
    import xxhash

    spans = repeated(docs, size, text_col)
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def printed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(_bytes(t)) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "t", "key"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(printed, f"id {kind}, t string, key binary")
    joined = rows.join(spans, F.col("key") == F.col("print"), "left").select("id", "t", "starts")

    def remove(batches):
        for b in batches:
            out = []
            for t, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, kept, at, gone, runs = _bytes(t), [], 0, 0, 0
                for a, z in sorted((x["a"], x["b"] + size) for x in starts or []):
                    if z <= at:
                        continue
                    if a > at or not runs:
                        kept.append(raw[at:a])
                        runs += 1
                    gone += z - max(a, at)
                    at = z
                kept.append(raw[at:])
                out.append((len(raw), gone, runs, b"".join(kept)))
            c = _columns(out, ["n_bytes", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])
            yield pa.RecordBatch.from_arrays([b.column(0), *c.columns], names=["id", *c.schema.names])

    return joined.mapInArrow(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)

"""Exact top-k by Hamming distance through incremental multi-index hashing (operator 2)."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Distinct codes in a shard of the index, about; query codes that one task holds for a shard.
SHARD, BLOCK = 4096, 4096
#: Keys of a segment that a query looks up in the second round at most.
TOGETHER = 1024


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is set where component i is above zero; null if the vector is null or shorter."""
    ones = [F.shiftleft(F.when(F.get(vector, F.lit(i)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), i) for i in range(bits)]
    code = ones[0]
    for x in ones[1:]:
        code = code.bitwiseOR(x)
    return F.when(F.size(vector) >= bits, code)


@cache
def flips(bits: int, r: int) -> np.ndarray:
    """All numbers of so many bits that have r ones."""
    if r > bits:
        return np.zeros(0, np.uint64)
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], np.uint64)


def count_of(bits: int, r: int) -> int:
    out = 1
    for k in range(r):
        out = out * (bits - k) // (k + 1)
    return out


class Keys:
    """The codes of one shard by the low bits of their segment."""

    def __init__(self, codes: np.ndarray, shift: int, bits: int):
        self.codes, self.bits, self.shift = codes, bits, np.uint64(shift)
        self.mask = np.uint64((1 << bits) - 1)
        keys = (codes >> self.shift) & self.mask
        self.order = np.argsort(keys, kind="stable")
        self.present, starts = np.unique(keys[self.order], return_index=True)
        self.starts = np.r_[starts, len(codes)]

    def within(self, q: np.uint64, low: int, high: int) -> np.ndarray:
        """Rows whose low bits differ from the query's in low to high places."""
        found = [self.at(q, r) for r in range(max(0, low), min(high, self.bits) + 1)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def at(self, q: np.uint64, r: int) -> np.ndarray:
        """Rows whose low bits differ from the query's in exactly r places.

        Each key at that distance is looked up, or each present key judged where these are fewer.
        """
        own = (q >> self.shift) & self.mask
        if count_of(self.bits, r) <= len(self.present):
            asked = own ^ flips(self.bits, r)
            at = np.searchsorted(self.present, asked)
            at = at[self.present[np.minimum(at, len(self.present) - 1)] == asked]
        else:
            at = np.flatnonzero(np.bitwise_count(self.present ^ own) == r)
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        return self.order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10, parts: int = 4, id_col: str = "vec_id", code_col: str = "code", shard_rows: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, distance): exactly the k nearest codes of 64 bits, the query's own row left out.

    queries: ids of rows of `codes`. Ties go to the smaller id. Of one code only the k + 1 smallest ids can
    ever be returned, so copies shrink to these before anything is dealt out, on the map side already.

    The index holds each distinct code once for each of its `parts` segments, in shards by segment and first
    bits of the segment. At radius r a query that is not yet covered goes to the shards whose first bits differ
    from its own in j <= r places, and looks up there the keys whose other bits differ in r - j. When radius r
    is done every code within parts * (r + 1) - 1 bits has been met, so a query whose kth distance is no more
    than that is covered and asks no further; the others hand out only codes no farther than their kth so far.
    Radii 0 and 1 are the first round, those of at most TOGETHER keys a segment the next, each further one its own. A shard that many codes share is dealt into parts, one that many
    queries ask into blocks of queries.

    Rows with a null id or code take no part; repeated rows count once; an empty table gives no rows; fewer
    than k other codes give fewer ranks; other columns are not read.
    """
    if 64 % parts:
        raise ValueError("parts must divide 64")
    spark = codes.sparkSession
    bounded_batches(spark, 10_000)
    width = 64 // parts
    rows = codes.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code")).where("id is not null and code is not null").distinct()
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("nth") <= k + 1)
    packed = stored(ranked.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = stored(rows.join(queries.select(F.col(id_col).cast("long").alias("q")).distinct(), F.col("id") == F.col("q"), "left_semi"), "asked")
    n, answers = packed.agg(F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    first = min(width, max(0, (n // shard_rows).bit_length()))  # bits of a segment that name its shard
    low = width - first

    def prefix(code, s):
        return F.shiftrightunsigned(code, s * width + low).bitwiseAND(F.lit((1 << first) - 1)).cast("int")

    segments = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), prefix(F.col("code"), s).alias("prefix")) for s in range(parts)])).alias("x")
    index = packed.select("code", "ids", segments).select("code", "ids", "x.*")
    sizes = stored(index.groupBy("segment", "prefix").agg(F.ceil(F.count(F.lit(1)) / (4 * shard_rows)).cast("int").alias("shares")), "index-sizes")
    index = index.join(sizes, ["segment", "prefix"]).select("code", "ids", "segment", "prefix", F.pmod(F.xxhash64("code"), F.col("shares")).cast("int").alias("share"))
    index = stored(index, "index")
    open_ = asked.select("code").distinct().withColumn("reach", F.lit(64))
    key = ["segment", "prefix", "share", "block"]
    kinds = "c long, vec_id long, distance int"

    def in_shard(least: int, r: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], []]
            if left.num_rows and right.num_rows:
                here = left.column("segment")[0].as_py(), left.column("prefix")[0].as_py()
                keys = Keys(left.column("code").to_numpy().view(np.uint64), here[0] * width, low)
                ids = left.column("ids").combine_chunks()
                flat, ends = ids.flatten().to_numpy(), np.cumsum(np.diff(ids.offsets.to_numpy()))
                starts = np.r_[0, ends[:-1]]
                for c, reach in zip(right.column("code").to_pylist(), right.column("reach").to_pylist()):
                    q = np.int64(c).view(np.uint64)
                    own = int(q >> np.uint64(here[0] * width + low)) & ((1 << first) - 1)
                    j = (own ^ here[1]).bit_count()
                    at = keys.within(q, least - j, r - j)
                    far = np.bitwise_count(keys.codes[at] ^ q)
                    at, far = at[far <= reach], far[far <= reach]
                    if len(at) > k + 1:  # codes beyond the (k + 1)st distance cannot be among the best
                        near = far <= np.partition(far, k)[k]
                        at, far = at[near], far[near]
                    best = sorted((int(d), i) for a, d in zip(at, far) for i in flat[starts[a] : ends[a]].tolist())[: k + 1]
                    for d, i in best:
                        for col, v in zip(out, (c, i, d)):
                            col.append(v)
            return pa.table({"c": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.int32())})

        return run

    nth = F.row_number().over(Window.partitionBy("c").orderBy("distance", "vec_id"))
    best = spark.createDataFrame([], kinds)
    start = max(1, *(r for r in range(width + 1) if sum(count_of(width, x) for x in range(r + 1)) <= TOGETHER))
    for least, r in [(0, 1), *([(2, start)] if start > 1 else []), *((x, x) for x in range(start + 1, width + 1))]:
        masks = [F.lit(int(m)) for j in range(min(r, first) + 1) if least - j <= low for m in flips(first, j)]
        visits = open_.select("code", "reach", segments).select("code", "reach", "x.segment", F.explode(F.transform(F.array(*masks), lambda m: F.col("x.prefix").bitwiseXOR(m.cast("int")))).alias("prefix"))
        visits = visits.join(sizes, ["segment", "prefix"]).select("code", "reach", "segment", "prefix", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        blocks = visits.groupBy("segment", "prefix", "share").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        visits = visits.join(blocks, key[:3]).select("code", "reach", *key[:3], F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int").alias("block"))
        data = index.join(blocks, key[:3]).select("code", "ids", *key[:3], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        found = data.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(in_shard(least, r), kinds)
        best = stored(best.unionByName(found).distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "best")
        so_far = best.groupBy("c").agg(F.count(F.lit(1)).alias("have"), F.max("distance").alias("kth"))
        covered = F.coalesce((F.col("have") >= min(k + 1, answers or 0)) & (F.col("kth") <= parts * (r + 1) - 1), F.lit(False))
        reach = F.when(F.col("have") > k, F.col("kth")).otherwise(64).alias("reach")
        open_ = stored(open_.drop("reach").join(so_far, F.col("code") == F.col("c"), "left").where(~covered).select("code", reach), "open")
        if not open_.take(1):
            break
    mine = asked.join(best, F.col("code") == F.col("c")).where(F.col("id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "distance")

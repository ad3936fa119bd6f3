"""Approximate nearest neighbours through low-dimensional stable projections and kd-trees (operator 1)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Rows of the sample that the upper kd-tree is fitted on (its bound); vectors in a cell, about; points in a leaf.
SAMPLE, CELL, LEAF = 20_000, 16_384, 64
#: Queries that one task holds at most for a cell; more are dealt out in blocks.
QUERIES = 8_192


def chi_square_cut(m: int, p: float) -> float:
    """x with P(chi-square of m degrees, m even, <= x) = p."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return low


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Tree:
    """A kd-tree by medians of the widest coordinate: split planes, and which leaf a point falls into."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []  # (axis, cut, left, right) or (leaf number,)
        self.leaves = 0
        self._grow(points, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        axis = int(spread.argmax())
        if leaves < 2 or len(points) < 2 or spread[axis] == 0:
            self.nodes[here] = (self.leaves,)
            self.leaves += 1
            return here
        cut = float(np.median(points[:, axis]))
        left = points[:, axis] <= cut
        if left.all():
            cut = float(np.max(points[points[:, axis] < cut, axis]))
            left = points[:, axis] <= cut
        a = self._grow(points[left], leaves // 2)
        b = self._grow(points[~left], leaves - leaves // 2)
        self.nodes[here] = (axis, cut, a, b)
        return here

    def cells(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            k, rows = todo.pop()
            node = self.nodes[k]
            if len(node) == 1:
                out[rows] = node[0]
                continue
            left = points[rows, node[0]] <= node[1]
            todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of q to each box."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(1)


def cosines(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, the same sum for the same row wherever it lies."""
    dots = (vectors * q).sum(1)
    return dots / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((q * q).sum()))


def search(ids, vectors, points, queries, k: int, cut: float):
    """(query, vec_id, cosine) of the best k of one cell for each query (id, vector, point, reach), and
    (query, None, None, vectors verified): verified in order of projected distance.

    The cell's kd-tree hands out leaves by their distance to the query's projection. A query stops when the
    next leaf is so far that a vector as near as its kth best would project closer with probability p: the
    squared projected distance over the squared true one is a chi-square variable. The same test holds each
    vector of a leaf against its own projected distance before its cosine is computed. reach: the squared
    distance of the kth best that the query has already.
    """
    tree = Tree(points, max(1, len(points) // LEAF))
    leaf = tree.cells(points)
    order = np.argsort(leaf, kind="stable")
    ids, vectors, points, leaf = ids[order], vectors[order], points[order], leaf[order]
    starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    ends = np.r_[starts[1:], len(leaf)]
    low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
    out = []
    for qid, q, at, reach in queries:
        far = box_distance(low, high, at)
        turn = np.argsort(far, kind="stable")
        best_s, best_i, step, pos, verified = np.zeros(0), np.zeros(0, ids.dtype), 4, 0, 0
        while pos < len(turn):
            edge = reach
            if len(best_s) >= k:
                edge = min(edge, 2 - 2 * best_s[k - 1])
            if far[turn[pos]] > cut * max(edge, 1e-12):
                break
            rows = np.concatenate([np.arange(starts[j], ends[j]) for j in turn[pos : pos + step]])
            gap = ((points[rows] - at) ** 2).sum(1)
            rows = rows[(ids[rows] != qid) & (gap <= cut * max(edge, 1e-12))]
            verified += len(rows)
            s = np.concatenate([best_s, cosines(vectors[rows], q)])
            i = np.concatenate([best_i, ids[rows]])
            top = np.lexsort((i, -s))[:k]
            best_s, best_i = s[top], i[top]
            pos, step = pos + step, min(64, step * 2)
        out += [(qid, int(i), float(s), 0) for i, s in zip(best_i, best_s)]
        out.append((qid, None, None, verified))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = 32, p: float = 0.9, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): each query's k nearest found by cosine, over all vectors but its
    own; verified: how many vectors its cosine was computed with.

    Unit vectors are projected on m Gaussian directions. An upper kd-tree, fitted on at most 20 000 projections,
    deals every vector to a cell of about `cell`; a cell that still is larger (copies of one vector) is dealt
    into parts. A query first searches its own cell, then, with the kth distance from there, those cells whose
    box the chi-square test can't rule out; so an unseen nearer vector is missed with probability 1 - p at most.
    Scores are exact cosines; ties go to the smaller id.

    Null ids, vectors that are null, zero, of another length than most, or with null or non-finite components
    take no part; lengths beyond the range of squares are scaled by a power of two, which changes no cosine.
    Copies count one by one. Queries are rows of `vectors` by id; of rows with one id the least in bytes asks, and
    none of them answers it. Empty tables give no rows; other columns are not read. The directory of boxes (m pairs of numbers a cell) is the only thing sent to all.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 5_000)
    wide = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    if wide is None or wide["d"] < 1:
        return empty
    dim = wide["d"]
    turn = directions(dim, m, seed)

    def project(batches):
        for b in batches:
            cols: list[list] = [[], [], []]
            for i, v in zip(*(c.to_pylist() for c in b.columns)):
                if i is None or v is None or len(v) != dim or None in v:
                    continue
                x = np.array(v, np.float64)
                most = np.abs(x).max()
                if not np.isfinite(most) or most == 0:
                    continue
                if not 1e-100 < most < 1e100:
                    x = np.ldexp(x, -int(np.frexp(most)[1]))
                size = np.sqrt((x * x).sum())
                for c, y in zip(cols, (i, x.tobytes(), (x / size @ turn).tobytes())):
                    c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["id", "v", "p"])

    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(project, "id long, v binary, p binary"), "projected")
    n = rows.count()
    if not n:
        return empty
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("p").collect()
    tree = Tree(np.array([np.frombuffer(r["p"]) for r in sample]), max(1, -(-n // cell)))

    def place(batches):
        for b in batches:
            points = np.array([np.frombuffer(x) for x in b.column(2).to_pylist()]).reshape(-1, m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.cells(points))], names=["id", "v", "p", "cell"])

    placed = stored(rows.mapInArrow(place, "id long, v binary, p binary, cell int"), "cells")

    def bounds(batches):
        for b in batches:
            points = np.array([np.frombuffer(x) for x in b.column(1).to_pylist()]).reshape(-1, m)
            cells = b.column(0).to_numpy()
            some = np.unique(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array([int((cells == c).sum()) for c in some], pa.int64()), pa.array([points[cells == c].min(0).tolist() for c in some]), pa.array([points[cells == c].max(0).tolist() for c in some])],
                names=["cell", "n", "low", "high"],
            )

    boxes = placed.select("cell", "p").mapInArrow(bounds, "cell int, n long, low array<double>, high array<double>")
    lows = [F.min(F.col("low")[j]).alias(f"l{j}") for j in range(m)] + [F.max(F.col("high")[j]).alias(f"h{j}") for j in range(m)]
    known = sorted(boxes.groupBy("cell").agg(F.sum("n").alias("n"), *lows).collect(), key=lambda r: r["cell"])
    number = {r["cell"]: j for j, r in enumerate(known)}
    low, high = (np.array([[r[f"{x}{j}"] for j in range(m)] for r in known]) for x in "lh")
    parts = np.array([max(1, round(r["n"] / cell)) for r in known])
    cut = chi_square_cut(m, p)
    parts_of = F.element_at(F.create_map(*[F.lit(x) for r, k_ in zip(known, parts) for x in (r["cell"], int(k_))]), F.col("cell")) if len(known) <= 1000 else None
    if parts_of is None:
        sizes = spark.createDataFrame([(r["cell"], int(k_)) for r, k_ in zip(known, parts)], "c int, parts int")
        dealt = placed.join(sizes, F.col("cell") == F.col("c")).drop("c")
    else:
        dealt = placed.withColumn("parts", parts_of)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = placed.join(queries.select(F.col(id_col).cast("long").alias("q")).where("q is not null").distinct(), F.col("id") == F.col("q"), "left_semi").groupBy("id").agg(F.min(F.struct("v", "p", "cell")).alias("x")).select("id", "x.*")

    def home(batches):
        for b in batches:
            cells, ids = b.column(3).to_pylist(), b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([i % int(parts[number[c]]) for i, c in zip(ids, cells)], pa.int32()), pa.array([1e300] * len(ids))], names=["id", "v", "p", "cell", "part", "reach"])

    def visit(batches):
        for b in batches:
            picks, cells, sub = [], [], []
            for r, (i, at, c0, d) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)))):
                far = box_distance(low, high, np.frombuffer(at))
                for j in np.flatnonzero(far <= cut * max(d, 1e-12)):
                    for s in range(parts[j]):
                        if known[j]["cell"] != c0 or s != i % int(parts[j]):
                            picks.append(r)
                            cells.append(known[j]["cell"])
                            sub.append(s)
            t = b.take(pa.array(picks, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(cells, pa.int32()), pa.array(sub, pa.int32()), t.column(4)], names=["id", "v", "p", "cell", "part", "reach"])

    def in_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_numpy()
        v, at = (np.array([np.frombuffer(x) for x in left.column(c).to_pylist()]) for c in "vp")
        asked_here = ((i, np.frombuffer(a), np.frombuffer(b), d) for i, a, b, d in zip(*(right.column(c).to_pylist() for c in ("id", "v", "p", "reach"))))
        got = search(ids, v, at, asked_here, k, cut) if len(ids) else []
        return pa.table({c: pa.array([g[n] for g in got], kind) for n, (c, kind) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())))})

    def look(visits: DataFrame) -> DataFrame:
        visits = stored(visits, "visits")
        blocks = visits.groupBy(F.col("cell").alias("c"), F.col("part").alias("s")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
        here = (F.col("cell") == F.col("c")) & (F.col("part") == F.col("s"))
        data = dealt.join(blocks, here).select("id", "v", "p", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        ask = visits.join(blocks, here).select("id", "v", "p", "reach", "cell", "part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        key = ["cell", "part", "block"]
        return data.groupBy(*key).cogroup(ask.groupBy(*key)).applyInArrow(in_cell, "query_id long, vec_id long, score double, verified long")

    first = stored(look(asked.mapInArrow(home, "id long, v binary, p binary, cell int, part int, reach double")), "nearest")
    kth = first.groupBy("query_id").agg(F.when(F.count("vec_id") >= k, 2 - 2 * F.min("score")).otherwise(F.lit(1e300)).alias("reach"))
    again = asked.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", "p", "cell", F.coalesce("reach", F.lit(1e300)).alias("reach"))
    second = look(again.mapInArrow(visit, "id long, v binary, p binary, cell int, part int, reach double"))
    found = first.unionByName(second)
    verified = found.groupBy(F.col("query_id").alias("q")).agg(F.sum("verified").alias("verified"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.where("vec_id is not null").drop("verified").withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(verified, F.col("query_id") == F.col("q")).select("query_id", "rank", "vec_id", "score", "verified")

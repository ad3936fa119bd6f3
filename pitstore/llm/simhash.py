"""SimHash near-duplicates through vantage-point trees (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .graph import components

#: Fingerprints in a shard, about; rows of a sample that the upper tree is built from (its bound).
SHARD, SAMPLE = 1 << 15, 4096
LEAF = 256


# --- fingerprints -----------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words of the ASCII-lowered text, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes set it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


# --- the tree ---------------------------------------------------------------------------------------------


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Union:
    """Sets of row numbers; the root is the smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            x = y

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def flat(self) -> np.ndarray:
        return self.find(np.arange(len(self.up)))


def split(codes: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves the codes best; None if they are all equally far."""
    for k in range(4):
        vantage = codes[(k * 7919 + len(codes) // 2) % len(codes)]
        d = np.sort(distance(codes, vantage))
        if d[0] != d[-1]:
            radius = int(d[(len(d) - 1) // 2])
            return vantage, radius if radius < d[-1] else int(d[np.searchsorted(d, radius) - 1])
    return None


def linked(codes: np.ndarray, resident: np.ndarray, radius: int, accept=None) -> Union:
    """Joins all rows within `radius` bits of each other of which one at least is a resident.

    A vantage-point tree over the residents: a branch is taken by every code whose ball of `radius` meets
    the branch's ring (triangle bound). accept(i, j): rows of pairs -> which of them count.
    """
    sets = Union(len(codes))

    def leaf(own: np.ndarray, guests: np.ndarray) -> None:
        other = np.concatenate([own, guests])
        step = max(1, (1 << (20 if accept is None else 14)) // max(1, len(other)))  # few at a time: most are joined soon
        for at in range(0, len(own), step):
            mine = own[at : at + step]
            i, j = np.nonzero(distance(codes[mine][:, None], codes[other][None, :]) <= radius)
            i, j = mine[i], other[j]
            apart = i != j
            i, j = i[apart], j[apart]
            if accept is not None and len(i):
                new = sets.find(i) != sets.find(j)  # what is joined already needs no second look
                i, j = i[new], j[new]
                ok = accept(i, j)
                i, j = i[ok], j[ok]
            sets.join(i, j)

    todo = [(np.flatnonzero(resident), np.flatnonzero(~resident))]
    while todo:
        own, guests = todo.pop()
        at = split(codes[own]) if len(own) > LEAF else None
        if at is None:
            leaf(own, guests)
            continue
        vantage, mu = at
        d, g = distance(codes[own], vantage).astype(int), distance(codes[guests], vantage).astype(int)
        inside = d <= mu
        near = own[inside & (d + radius > mu)]
        todo.append((own[inside], guests[g - radius <= mu]))
        todo.append((own[~inside], np.concatenate([near, guests[g + radius > mu]])))
    return sets


def judge_rest(sets: Union, n: np.ndarray, similarity: float, accept) -> None:
    """Joins all accepted pairs that are not joined yet, at any distance.

    Only sizes rule a pair out: sets of which one has less than `similarity` of the other's members cannot be
    that similar.
    """
    order = np.argsort(n, kind="stable")
    size = n[order]
    end = np.searchsorted(size, np.floor(size / similarity + 1e-9), side="right")
    at = 0
    while at < len(order):
        upto = at + max(1, int(np.searchsorted(np.cumsum(end[at:] - np.arange(at, len(order))), 1 << 16)))
        count = end[at:upto] - np.arange(at, min(upto, len(order))) - 1
        first = np.repeat(np.arange(at, min(upto, len(order))), count)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        i, j = order[first], order[second]
        for k in range(0, len(i), 1 << 14):
            a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            new = sets.find(a) != sets.find(b)
            a, b = a[new], b[new]
            ok = accept(a, b) if len(a) else np.zeros(0, bool)
            sets.join(a[ok], b[ok])
        at = upto


def upper_tree(sample: np.ndarray, depth: int):
    """Nested (vantage, radius, inner, outer); None is a shard."""
    at = split(sample) if depth and len(sample) > 1 else None
    if at is None:
        return None
    d = distance(sample, at[0])
    return (*at, upper_tree(sample[d <= at[1]], depth - 1), upper_tree(sample[d > at[1]], depth - 1))


def route(tree, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, resident): each code's own shard and those whose border its ball crosses from inside."""
    out, todo, shard = [], [(tree, np.arange(len(codes)), np.ones(len(codes), bool))], 0
    while todo:
        node, rows, home = todo.pop()
        if node is None:
            out.append((rows, np.full(len(rows), shard), home))
            shard += 1
            continue
        vantage, mu, inner, outer = node
        d = distance(codes[rows], vantage).astype(int)
        to_outer = (d > mu) | (d + radius > mu)
        to_inner = (d <= mu) | (~home & (d - radius <= mu))
        todo.append((outer, rows[to_outer], home[to_outer] & (d[to_outer] > mu)))
        todo.append((inner, rows[to_inner], home[to_inner] & (d[to_inner] <= mu)))
    return tuple(np.concatenate(x) for x in zip(*out))


# --- the operator -----------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long; no words give zero."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            codes = np.array([fingerprint(shingle_hashes(t, shingle)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def links(codes: DataFrame, radius: int, shard_rows: int = SHARD) -> DataFrame:
    """codes (fp, distinct) -> star edges (a, b) that connect whatever lies within `radius` bits, over chains too.

    Upper tree: from a sample of at most 4096 codes, split until a shard holds about `shard_rows`. A code goes
    to its own shard and, as a guest, to those that its ball reaches from inside a border. Shards are joined
    by a tree each. Only codes with a link are returned, each with one edge a shard.
    """
    spark = codes.sparkSession
    n = codes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard_rows)))))
    sample = codes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if depth else []
    tree = upper_tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), depth)

    def send(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            rows, shard, home = route(tree, fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(shard.astype(np.int32)), pa.array(home)], names=["fp", "shard", "home"])

    def shard_links(part: pa.Table) -> pa.Table:
        fp = part.column("fp").to_numpy()
        fp = np.ascontiguousarray(fp)
        top = linked(fp.view(np.uint64), part.column("home").to_numpy(), radius).flat()
        some = top != np.arange(len(top))
        return pa.table({"a": fp[some], "b": fp[top[some]]})

    prepared = bounded_batches(spark, 10_000)  # noqa: F841  codes are short
    return codes.select("fp").mapInArrow(send, "fp long, shard int, home boolean").groupBy("shard").applyInArrow(shard_links, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id it reaches).

    Documents with one fingerprint are one node from the start, so copies are never paired. Null and empty
    texts have fingerprint zero and are linked like any other; a null id is kept and never is a component's
    name unless all its ids are null; repeated rows stay; an empty table gives no rows; other columns are
    not read.
    """
    found = stored(fingerprints(docs, shingle, id_col, text_col), "simhash")
    codes = stored(found.groupBy("fp").agg(F.min("id").alias("first")), "simhash-codes")
    roots = components(links(codes, radius, shard_rows))
    named = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(smallest.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return found.join(names, found["fp"] == names["f"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity ----------------------------------------------------------------------------

#: Members of a block that one task compares at most; larger blocks are dealt out as pairs of parts.
BLOCK = 1024
#: Pairs whose sketches are compared at once: 2 MB at 256 values each.
PAIRS = 512
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]  # multipliers of the min-hashes


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = h * np.uint64(ODD[k])
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


NONE = np.uint64(np.iinfo(np.uint64).max)


def resemblances(low: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Jaccard similarity of many pairs of rows from sorted bottom-`size` sketches (padded with NONE).

    Exact where both sets fit into the sketch; else the share of common ones among the `size` smallest of both.
    """
    both = np.concatenate([low[i, :size], low[j, :size]], axis=1)
    both.sort(axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
    rank = np.cumsum(~twice, axis=1, dtype=np.int32)
    most = np.where(np.maximum(n[i], n[j]) <= size, 2 * size, size)
    union = np.minimum(((both != NONE) & ~twice).sum(1), most)
    return (twice & (rank <= most[:, None])).sum(1) / np.maximum(union, 1)


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 18, sketch: int = 256, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies (id, rep), roots (node, root)): documents equal in words, and groups of those whose sets of
    `shingle`-word runs have a Jaccard similarity of at least `similarity`.

    A similarity of 0.8 turns over about ten of 64 fingerprint bits, a radius at which triangle bounds exclude
    nothing, and no number of bits is proven. So fingerprints (of the distinct shingles) are first parted by five
    min-hashes of the same shingles (0.8 leaves 3 pairs in 10 000 without a common one); in each block a tree
    joins what it finds within `radius` bits, as the likeliest, and then all pairs that are still apart are
    judged, whatever their distance. Bottom-`sketch` samples decide for sets that fit into them. For larger ones
    they only reject, with a margin; what is left meets again with the whole sets. Blocks of more than 1024 are dealt out as pairs of parts: nothing is capped.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    import xxhash

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, shingle)
                s = np.unique(h)
                low = np.sort(_mixed(s, 0))[:sketch]
                mins = [int(_mixed(s, k).view(np.int64)[np.argmin(_mixed(s, k))]) for k in range(len(ODD))] if len(s) else []
                joined = b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())
                for c, v in zip(cols, (xxhash.xxh3_128_digest(joined), len(s), int(np.uint64(fingerprint(s)).view(np.int64)), mins, low.tobytes())):
                    c.append(v)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", "words", "n", "fp", "mins", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.col("id").isNotNull())
    made = stored(named.mapInArrow(run, f"id {kind}, words binary, n long, fp long, mins array<long>, sketch binary"), "sketches")
    reps = stored(made.groupBy("words").agg(F.min("id").alias("rep")), "words")
    copies = made.select("id", "words").join(reps, "words").where("id <> rep").select("id", "rep")
    # light rows: which blocks have company, and how much
    one = made.select("id", "words", F.posexplode("mins").alias("t", "m")).join(reps.select(F.col("words").alias("w"), "rep"), (F.col("words") == F.col("w")) & (F.col("id") == F.col("rep"))).select("id", "t", "m").distinct()
    one = stored(one, "blocks")
    sizes = one.groupBy("t", "m").count().where("count > 1").select(F.col("t").alias("t2"), F.col("m").alias("m2"), "count")
    met = one.join(sizes, (F.col("t") == F.col("t2")) & (F.col("m") == F.col("m2"))).select("id", "t", "m", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    spots = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(mine, q).alias("p"), F.greatest(mine, q).alias("q"))))
    sent = met.select("id", "t", "m", spots.alias("s")).select(F.col("id").alias("i"), "t", "m", "s.p", "s.q")
    payload = made.select("id", "n", "fp", "sketch").join(met.select(F.col("id").alias("i")).distinct(), F.col("id") == F.col("i"), "left_semi").dropDuplicates(["id"])
    rows = payload.join(sent, F.col("id") == F.col("i")).select("t", "m", "p", "q", "id", "n", "fp", "sketch")
    width = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind_pa = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()

    def look(n, low, i, j):
        """(similar, perhaps similar): sketches decide where both sets fit, else they only reject, six deviations off."""
        most = np.maximum(n[i], n[j])
        ok = np.minimum(n[i], n[j]) >= similarity * most
        for width, slack in ((sketch // 4, 0.3), (sketch, 0.15)):  # a coarse look spares most
            at = np.flatnonzero(ok)
            for k in range(0, len(at), PAIRS):
                part = at[k : k + PAIRS]
                ok[part] = resemblances(low, n, i[part], j[part], width) >= np.where(most[part] <= width, similarity, similarity - slack)
        return ok & (most <= sketch), ok & (most > sketch)

    def matrix(sets):
        wide = np.full((len(sets), sketch), NONE, np.uint64)
        for k, x in enumerate(sets):
            wide[k, : min(sketch, len(x))] = x[:sketch]
        return wide

    def joined(fp, n, accept):
        sets = linked(fp, np.ones(len(fp), bool), radius, accept)
        judge_rest(sets, n, similarity, accept)
        return [(k, r) for k, r in enumerate(sets.flat()) if k != r]

    def sketched(held, block):
        """Edges that sketches prove, and as (id, null, block) the members of pairs that take the whole sets."""
        ids, n, fp, low = zip(*block)
        n, low, open_ = np.array(n), matrix([np.frombuffer(x, np.uint64) for x in low]), np.zeros(len(ids), bool)

        def accept(i, j):
            at = np.flatnonzero(~(open_[i] & open_[j]))  # these meet again with their whole sets
            sure, perhaps = look(n, low, i[at], j[at])
            open_[i[at[perhaps]]] = open_[j[at[perhaps]]] = True
            out = np.zeros(len(i), bool)
            out[at[sure]] = True
            return out

        edges = joined(np.array(fp, np.int64).view(np.uint64), n, accept)
        return [(ids[k], ids[r], None, None, None, None) for k, r in edges] + [(ids[k], None, *held) for k in np.flatnonzero(open_)]

    def compared(held, block):
        """Edges by the whole sets."""
        ids, fp, sets = zip(*block)
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        n, low, tied = np.array([len(x) for x in sets]), matrix(sets), Union(len(ids))

        def accept(i, j):
            sure, perhaps = look(n, low, i, j)
            tied.join(i[sure], j[sure])
            for k in np.flatnonzero(perhaps):
                a, b = i[k : k + 1], j[k : k + 1]
                if tied.find(a)[0] != tied.find(b)[0]:
                    common = len(np.intersect1d(sets[a[0]], sets[b[0]], assume_unique=True))
                    if common >= similarity * (n[a[0]] + n[b[0]] - common):
                        sure[k] = True
                        tied.join(a, b)
            return sure

        return [(ids[k], ids[r], None, None, None, None) for k, r in joined(np.array(fp, np.int64).view(np.uint64), n, accept)]

    def by_block(judge):
        names, kinds = ["a", "b", "t", "m", "p", "q"], [kind_pa, kind_pa, pa.int32(), pa.int64(), pa.int32(), pa.int32()]

        def run(batches):
            held, block = None, []
            for b in batches:
                found = []
                for t, m, p, q, *row in zip(*(c.to_pylist() for c in b.columns)):
                    if (t, m, p, q) != held:
                        found += judge(held, block) if len(block) > 1 else []
                        held, block = (t, m, p, q), []
                    block.append(row)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
            found = judge(held, block) if len(block) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        return run

    def whole(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column(1).to_pylist()]
            fp = pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, pa.array([np.sort(_mixed(s, 0)).tobytes() for s in sets], pa.binary())], names=["id", "fp", "full"])

    def dealt(frame, judge):
        placed = frame.repartition(width, "t", "m", "p", "q").sortWithinPartitions("t", "m", "p", "q", "id")
        return placed.mapInArrow(by_block(judge), f"a {kind}, b {kind}, t int, m long, p int, q int")

    first = stored(dealt(rows, sketched), "near-pairs")
    unsure = first.where("b is null").select(F.col("a").alias("i"), "t", "m", "p", "q")
    texts = named.join(unsure.select("i").distinct(), F.col("id") == F.col("i"), "left_semi").dropDuplicates(["id"])
    again = texts.mapInArrow(whole, f"id {kind}, fp long, full binary").join(unsure, F.col("id") == F.col("i")).select("t", "m", "p", "q", "id", "fp", "full")
    edges = first.where("b is not null").select("a", "b").unionByName(dealt(again, compared).select("a", "b"))
    return copies, components(edges)


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that have a near copy of smaller id in their group: one of each group stays.

    Texts without words are copies of each other. Rows of one id are one document and stay or go together;
    rows with a null id always stay; null text counts as empty; other columns pass through.
    """
    copies, roots = similar_groups(docs, similarity, shingle, id_col=id_col, text_col=text_col)
    gone = copies.select(F.col("id").alias("gone_id")).unionByName(roots.where("node <> root").select(F.col("node").alias("gone_id"))).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")

"""Subword lattice likelihood: the marginal probability of whole texts over all segmentations (operator 10)."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Words whose counts every task holds (the most frequent ones); the counts of the others are joined.
FREQUENT = 50_000
FLUSH = 300_000
#: Words of up to this many characters are spelled together with others of their length.
TOGETHER = 40
LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0


_VOCABULARY: dict[str, tuple] = {}


def vocabulary(path: str) -> tuple:
    """(sentencepiece processor, {piece: id} of the pieces that spell text, {byte: id}); one for each process."""
    if path not in _VOCABULARY:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, byte = {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[sp.id_to_piece(i)] = i
        _VOCABULARY[path] = sp, plain, byte
    return _VOCABULARY[path]


class Lattice:
    """All ways to spell a word, opened by the mark of a space, with pieces of the vocabulary.

    logs: natural-log probability of each piece by id. A character that no
    piece spells on its own is spelled by its bytes.
    """

    def __init__(self, path: str, logs: np.ndarray):
        _, plain, byte = vocabulary(path)
        self.logs = logs.tolist()
        self.ids, self.byte = plain, byte
        self.log_of = {p: self.logs[i] for p, i in plain.items()}
        self.longest = max(map(len, plain), default=1)

    def _bytes(self, c: str) -> float:
        return sum(self.logs[self.byte[b]] for b in c.encode("utf-8", "surrogatepass"))

    def arcs(self, s: str, at: int):
        """(end, log probability, piece id or None for bytes) of each piece that starts here."""
        out, known = [], self.log_of
        for e in range(at + 1, min(len(s), at + self.longest) + 1):
            lp = known.get(s[at:e])
            if lp is not None:
                out.append((e, lp, self.ids[s[at:e]]))
        if not out or out[0][0] != at + 1:
            out.append((at + 1, self._bytes(s[at]), None))
        return out

    def forward(self, s: str) -> list[float]:
        """Log probability of reaching each place: a forward recursion in log space over a sliding span."""
        reach = [-math.inf] * (len(s) + 1)
        reach[0] = 0.0
        exp, log, get, longest, n = math.exp, math.log, self.log_of.get, self.longest, len(s)
        for at in range(n):
            here = reach[at]
            if here == -math.inf:
                continue
            single = False
            for e in range(at + 1, min(n, at + longest) + 1):
                lp = get(s[at:e])
                if lp is None:
                    continue
                if e == at + 1:
                    single = True
                x, y = here + lp, reach[e]
                if y == -math.inf:
                    reach[e] = x
                elif x > y:
                    reach[e] = x + log(1 + exp(y - x))
                else:
                    reach[e] = y + log(1 + exp(x - y))
            if not single:
                x, y = here + self._bytes(s[at]), reach[at + 1]
                reach[at + 1] = max(x, y) + log(1 + exp(-abs(x - y))) if y > -math.inf else x
        return reach

    def word(self, w: bytes) -> float:
        return self.forward("▁" + w.decode("utf-8", "surrogatepass"))[-1]

    def expected(self, w: bytes, weight: float, into: np.ndarray) -> None:
        """Adds the expected uses of each piece over all segmentations of the word, `weight` times."""
        s = "▁" + w.decode("utf-8", "surrogatepass")
        reach, back = self.forward(s), [-math.inf] * (len(s) + 1)
        back[-1] = 0.0
        total = reach[-1]
        for at in range(len(s) - 1, -1, -1):
            if reach[at] == -math.inf:
                continue
            for e, lp, i in self.arcs(s, at):
                x = lp + back[e]
                if x == -math.inf:
                    continue
                back[at] = x if back[at] == -math.inf else max(x, back[at]) + math.log(1 + math.exp(-abs(x - back[at])))
                part = weight * math.exp(reach[at] + x - total)
                if i is not None:
                    into[i] += part
                else:
                    for b in s[at].encode("utf-8", "surrogatepass"):
                        into[self.byte[b]] += part


_TRIES: dict[str, tuple] = {}
#: A trie's key holds a code point in so many low bits, the node above them.
POINT = 21


def trie(path: str) -> tuple:
    """(root's child by code point, sorted keys (node, code point), child of each key, piece id that ends at a node or -1)."""
    if path not in _TRIES:
        ids = vocabulary(path)[1]
        child: dict[tuple[int, int], int] = {}
        ends = {}
        for piece, i in ids.items():
            node = 0
            for c in piece:
                node = child.setdefault((node, ord(c)), len(child) + 1)
            ends[node] = i
        term = np.full(len(child) + 1, -1, np.int64)
        term[list(ends)] = list(ends.values())
        keys = np.array([node << POINT | c for node, c in child], np.int64)
        order = np.argsort(keys)
        nodes = np.array(list(child.values()), np.int64)
        root = np.full(1 << POINT, -1, np.int64)
        first = keys < 1 << POINT
        root[keys[first]] = nodes[first]
        _TRIES[path] = root, np.r_[keys[order], np.iinfo(np.int64).max], np.r_[nodes[order], -1], term
    return _TRIES[path]


class Lattices:
    """The lattices of several classes, over many words at a time: the recursion runs over all words of a length.

    logs: (classes, pieces). A character that no piece spells gets a column of its own, the sum of its bytes'.
    """

    def __init__(self, path: str, logs: np.ndarray):
        self.path, self.logs = path, logs
        _, self.ids, self.byte = vocabulary(path)
        self.longest = max(map(len, self.ids), default=1)
        self.root, self.keys, self.child, self.term = trie(path)

    def _arcs(self, words: list[str], n: int):
        """[(from, to, rows, piece of each)] for words of n characters; the logs with columns for odd characters; these.

        All words walk down the trie of pieces together; those that leave it take no further part.
        """
        points = np.array(words, f"U{n}").view(np.uint32).reshape(-1, n).astype(np.int64)
        odd, out, size = {}, [], self.logs.shape[1]
        for at in range(n):
            node = self.root[points[:, at]]
            piece = np.where(node >= 0, self.term[node], -1)
            lone = np.flatnonzero(piece < 0)
            for k in lone:
                piece[k] = size + odd.setdefault(words[k][at], len(odd))
            out.append((at, at + 1, slice(None), piece))
            rows = np.flatnonzero(node >= 0)
            node = node[rows]
            for e in range(at + 1, min(n, at + self.longest)):
                key = node << POINT | points[rows, e]
                place = np.searchsorted(self.keys, key)
                on = self.keys[place] == key
                rows, node = rows[on], self.child[place[on]]
                if not len(rows):
                    break
                piece = self.term[node]
                ends = piece >= 0
                if ends.any():
                    out.append((at, e + 1, rows[ends], piece[ends]))
        spelled = [self.logs[:, [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]].sum(1) for c in odd]
        return out, np.column_stack([self.logs, *spelled]) if odd else self.logs, list(odd)

    def _groups(self, words: list[bytes]):
        spelled = ["▁" + w.decode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(w) for w in spelled])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for k in range(0, len(at), 4096):
                yield int(n), at[k : k + 4096], [spelled[i] for i in at[k : k + 4096]]

    def words(self, words: list[bytes]) -> np.ndarray:
        """(classes, words): log probability of each word, over all its segmentations."""
        out = np.zeros((len(self.logs), len(words)))
        for n, at, some in self._groups(words):
            if n > TOGETHER:
                single = [Lattice(self.path, x) for x in self.logs]
                out[:, at] = [[x.forward(w)[-1] for w in some] for x in single]
                continue
            arcs, logs, _ = self._arcs(some, n)
            reach = np.full((n + 1, len(logs), len(some)), -np.inf)
            reach[0] = 0.0
            for a, e, rows, ids in arcs:
                reach[e][:, rows] = np.logaddexp(reach[e][:, rows], reach[a][:, rows] + logs[:, ids])
            out[:, at] = reach[n]
        return out

    def expected(self, words: list[bytes], classes: np.ndarray, into: np.ndarray) -> None:
        """Adds the expected uses of each piece in the class of each word: classes has its number."""
        size = self.logs.shape[1]
        for n, at, some in self._groups(words):
            if n > TOGETHER:
                for i in at:
                    Lattice(self.path, self.logs[classes[i]]).expected(words[i], 1.0, into[classes[i]])
                continue
            arcs, logs, odd = self._arcs(some, n)
            own, wide = classes[at], logs.shape[1]
            reach, back = np.full((2, n + 1, len(some)), -np.inf)
            reach[0] = back[n] = 0.0
            steps = [logs[own[rows], ids] for _, _, rows, ids in arcs]
            for (a, e, rows, _), lp in zip(arcs, steps):
                reach[e][rows] = np.logaddexp(reach[e][rows], reach[a][rows] + lp)
            total = np.zeros(len(logs) * wide)
            for (a, e, rows, ids), lp in zip(reversed(arcs), reversed(steps)):
                x = back[e][rows] + lp
                back[a][rows] = np.logaddexp(back[a][rows], x)
                np.add.at(total, own[rows] * wide + ids, np.exp(reach[a][rows] + x - reach[n][rows]))
            total = total.reshape(len(logs), wide)
            into += total[:, :size]
            for k, c in enumerate(odd):
                for b in c.encode("utf-8", "surrogatepass"):
                    into[:, self.byte[b]] += total[:, size + k]


def _classes(docs: DataFrame, class_col: str | None, most: int) -> list[str]:
    """The values of the column that get a model of their own: the `most` most frequent; all others share one."""
    if class_col is None:
        return []
    top = docs.groupBy(docs[class_col].cast("string").alias("z")).count().where("z is not null").orderBy(F.desc("count"), "z").limit(most).collect()
    return sorted(r["z"] for r in top)


def word_counts(docs: DataFrame, classes: list[str], m: int, id_col: str, text_col: str, class_col: str | None) -> DataFrame:
    """(w, c0, c1, ...): each word of any text and how often the training texts of each class have it.

    Summed up in each task before the shuffle; words of held-out texts alone have zeros.
    """
    bounded_batches(docs.sparkSession)
    number = {z: k for k, z in enumerate(classes)}

    def run(batches):
        have: dict[int, Counter] = {}  # by class; words of held-out texts alone stay at zero

        def rows():
            flat = [(w, z, c) for z, own in have.items() for w, c in own.items()]
            w, z, c = zip(*flat) if flat else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(z, pa.int32()), pa.array(c, pa.int64())], names=["w", "z", "c"])

        for b in batches:
            for i, t, z in zip(*(b.column(c).to_pylist() for c in range(3))):
                words = words_of(t)
                own = have.setdefault(number.get(z, len(classes)), Counter())
                own.update(dict.fromkeys(words, 0) if held_out(i) else words)
            if sum(map(len, have.values())) >= FLUSH:
                yield rows()
                have = {}
        yield rows()

    z = docs[class_col].cast("string") if class_col else F.lit(None).cast("string")
    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"), z.alias("z"))
    return named.mapInArrow(run, "w binary, z int, c long").groupBy("w").agg(*[F.sum(F.when(F.col("z") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(m)])


def piece_logs(counts: DataFrame, ends: int, path: str, rounds: int, classes: int, prior: float = 0.1) -> np.ndarray:
    """For each class, log probabilities of the vocabulary's pieces, from all words that its training texts use.

    Every different word counts once: the lattice has to spell new words, and these resemble the many rare
    ones. The file's own scores are merge ranks, no probabilities, so the first estimate is how often the
    file's segmentation uses each piece; each round replaces it by the expected uses over all segmentations.
    """
    spark = counts.sparkSession
    size = vocabulary(path)[0].get_piece_size()

    def summed(frame: DataFrame) -> np.ndarray:
        out = np.zeros((classes, size))
        t = frame.groupBy("z", "piece").agg(F.sum("n").alias("n")).toArrow()  # at most classes x the vocabulary's size
        out[t["z"].to_numpy(), t["piece"].to_numpy()] = t["n"].to_numpy()
        return out

    def rows(total: np.ndarray):
        z, some = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)), pa.array(some.astype(np.int32)), pa.array(total[z, some])], names=["z", "piece", "n"])

    def first(batches):
        sp, total = vocabulary(path)[0], np.zeros((classes, size))
        for b in batches:
            texts = [w.decode("utf-8", "surrogatepass") for w in b.column(0).to_pylist()]
            uses = np.array([b.column(1 + z).to_numpy() > 0 for z in range(classes)])
            for ids, own in zip(sp.encode(texts, num_threads=1), uses.T):
                for z in np.flatnonzero(own):
                    np.add.at(total[z], ids, 1)
        yield rows(total)

    def logs_of(total: np.ndarray) -> np.ndarray:
        _, plain, byte = vocabulary(path)
        ok = np.zeros(size, bool)
        ok[[*plain.values(), *byte.values()]] = True
        mass = np.where(ok, total + prior, 0)
        with np.errstate(divide="ignore"):
            return np.log(mass / mass.sum(1, keepdims=True))

    logs = logs_of(summed(counts.mapInArrow(first, "z int, piece int, n double")))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logs)

        def again(batches, shared=shared):
            lattices, total = Lattices(path, shared.value), np.zeros((classes, size))
            for b in batches:
                words = b.column(0).to_pylist()
                z, at = np.nonzero([b.column(1 + z).to_numpy() > 0 for z in range(classes)])
                lattices.expected([words[i] for i in at], z, total)  # each word in the classes that use it
            yield rows(total)

        logs = logs_of(summed(counts.mapInArrow(again, "z int, piece int, n double")))
    return logs


def likelihood(docs: DataFrame, tokenizer: str, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", most_classes: int = 8, frequent: int = FREQUENT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole text; logs to base 10.

    Texts whose crc32(id as text) mod 10 is not 0 train. base_score: word unigrams with 0.1 added. score: the
    marginal probability of the text's words and its end. A word's probability in a class sums over all its
    segmentations into the vocabulary's pieces (forward recursion in log space) and over the whole word as one
    more piece, where the training texts have it; the pieces together get the share that words seen once have
    of all tokens. A text's probability sums over the classes (values of class_col, the 8 most frequent and one
    for the rest), whatever its own class is said to be.

    Null and empty texts are an end alone; a null id counts as empty text in the crc; repeated rows stay; an
    empty table gives no rows; other columns are not read. Each different word is spelled once; the 50 000
    most frequent words go to all tasks with their scores (a fixed bound), all others are joined, so no word is
    a hot key.
    """
    spark = docs.sparkSession
    classes = _classes(docs, class_col, most_classes)
    others = docs.where(docs[class_col].cast("string").isNull() | ~docs[class_col].cast("string").isin(classes)).limit(1).count() if classes else 1
    m = len(classes) + (others > 0)  # the class of all others, where there are any
    counts = stored(word_counts(docs, classes, m, id_col, text_col, class_col), "words")
    crc = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    z = docs[class_col].cast("string") if class_col else F.lit(None).cast("string")
    texts = {r["z"]: r["n"] for r in docs.where(crc % 10 != 0).groupBy(F.when(z.isin(classes), z).alias("z") if classes else F.lit(None).cast("string").alias("z")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = np.array([*[texts.get(x, 0) for x in classes], texts.get(None, 0)][:m], float)
    all_c = sum((F.col(f"c{k}") for k in range(m)), F.lit(0))
    sums = counts.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(m)], F.count_if(all_c > 0).alias("v"), F.count_if(all_c == 1).alias("once")).first()
    by_class = np.array([sums[f"c{k}"] or 0 for k in range(m)], float) + ends
    n, v = int(by_class.sum()), sums["v"] + int(ends.sum() > 0)
    norm = math.log10(n + 0.1 * (v + 1))
    new = min(0.5, max((sums["once"] + 1) / (n + 2), 1e-6))  # the share of words not seen before
    bounded_batches(spark, 20_000)
    logs = spark.sparkContext.broadcast(piece_logs(counts, int(ends.sum()), tokenizer, rounds, m))

    def spelled(batches):
        lattices = Lattices(tokenizer, logs.value)
        for b in batches:
            c = np.array([b.column(1 + k).to_numpy() for k in range(m)], float)
            words = b.column(0).to_pylist()
            whole = 0.8 * c / np.maximum(by_class, 1)[:, None] + 0.2 * c.sum(0) / max(n, 1)
            floor = lattices.words(words) + math.log(new)
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log((1 - new) * whole), floor) / LN10
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(c.sum(0).astype(np.int64)), pa.array(np.log10(c.sum(0) + 0.1) - norm), *[pa.array(lp[k]) for k in range(m)]],
                names=["w", "c", "base", *[f"p{k}" for k in range(m)]],
            )

    kinds = "w binary, c long, base double, " + ", ".join(f"p{k} double" for k in range(m))
    words = stored(counts.mapInArrow(spelled, kinds), "spelled")
    most = words.orderBy(F.desc("c"), "w").limit(frequent).toArrow()
    place = {w: k for k, w in enumerate(most["w"].to_pylist())}
    model = spark.sparkContext.broadcast((place, np.column_stack([most["base"].to_numpy(), most["c"].to_numpy() > 0, *[most[f"p{k}"].to_numpy() for k in range(m)]]) if place else np.zeros((0, m + 2))))
    end_log = np.log10(np.maximum(0.8 * ends / np.maximum(by_class, 1) + 0.2 * ends.sum() / max(n, 1), 1e-9)) + math.log10(1 - new)
    prior = np.log10((ends + 0.5) / (ends + 0.5).sum())
    bounded_batches(spark)

    def run(batches):
        (place, known), row = model.value, TaskContext.get().partitionId() << 40
        end = np.r_[math.log10(ends.sum() + 0.1) - norm, float(ends.sum() > 0), end_log + prior]
        for b in batches:
            ids = b.column(0).to_pylist()
            n, sums, rest, times = [], [], [], []
            for t in b.column(1).to_pylist():
                have = Counter(words_of(t))
                at = np.array([place.get(w, -1) for w in have], np.int64)
                ks = np.array(list(have.values()), np.int64)
                n.append(int(ks.sum()) + 1)
                sums.append(end + ks[at >= 0] @ known[at[at >= 0]])
                rest.append([w for w, x in zip(have, at) if x < 0])
                times.append(ks[at < 0])
            sums = np.array(sums).reshape(-1, m + 2)
            lists = pa.ListArray.from_arrays(np.arange(0, (m * len(ids)) + 1, m, dtype=np.int32), pa.array(sums[:, 2:].ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.arange(row, row + len(ids))), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(n, pa.int64()), pa.array(sums[:, 1].astype(np.int64)), pa.array(sums[:, 0]), lists, pa.array(rest, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                names=["id", "row", "held_out", "n_tokens", "known", "base", "scores", "words", "times"],
            )
            row += len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stored(docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(run, f"id {kind}, row long, held_out boolean, n_tokens long, known long, base double, scores array<double>, words array<binary>, times array<long>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    found = rare.join(words, rare["word"] == words["w"]).groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("k") * F.col("base")).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("also"), *[F.sum(F.col("k") * F.col(f"p{j}")).alias(f"s{j}") for j in range(m)]
    )
    out = scored.select("id", "row", "held_out", "n_tokens", "known", "base", "scores").join(found, F.col("row") == F.col("r"), "left")
    parts = [F.col("scores")[j] + F.coalesce(f"s{j}", F.lit(0.0)) for j in range(m)]
    best = F.greatest(*parts) if m > 1 else parts[0]
    total = sum((F.pow(F.lit(10.0), x - best) for x in parts), F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (best + F.log10(total)).alias("score")
    )

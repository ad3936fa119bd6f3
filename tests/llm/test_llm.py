"""Each operator against a brute-force version, and on nulls, empties, ties, repeats, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from pitstore.llm import bpe, lattice, line_dedup, mixing, multi_index, packing, projections, queries, simhash, suffix_dedup, token_counts, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, pos int, word string, starts string"

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(200)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def lines(n, m):
    return "\n".join(text(m) for _ in range(n))


SHARED = lines(5, 20)


def corpus():
    out = []
    for k in range(40):
        t = lines(rng.randint(1, 6), rng.randint(1, 30))
        if k % 4 == 0:
            t += "\n" + SHARED
        out.append((k, t, "ab"[k % 2], f"s{min(k % 7, 3)}"))
    out += [(100 + k, out[k][1], "a", "s0") for k in range(4)]
    out += [(200, None, None, None), (201, "", "a", "s1"), (202, " \t\n", "a", None), (203, "x " * 3000, "b", "s0"), (3, out[3][1], "b", "s3"), (None, "no id at all", "a", "s1"), (204, "a" * 900, "a", "s0")]
    return out


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, s, 1, "x", 2, 3, "w", "y") for i, t, g, s in ROWS], DOCS).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


# --- token counts, packing --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(library):
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "12", ".", "'s", "'", "re", "ll", "<|endoftext|>", "<|endof", "text|>", "x" * 40, " foo", "\r\n", "\x1c", "🙂", "\x85", " hello world this is "]
    whole, chunked = bpe.Encoder(BYTE_BPE), bpe.Encoder(BYTE_BPE, chunk=60, overlap=8)
    for _ in range(600):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 80)))
        want = np.array(library(x), "<u4").tobytes()
        assert whole.ids(x) == want == chunked.ids(x), x
    assert chunked.spliced["splices"] > 300 and chunked.spliced["widened"]


def test_pieces_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "12", ".", "x" * 30, " foo", "🙂", " hello world this is ", "▁", "\u3000"]
    chunked = bpe.Encoder(PIECES, chunk=60, overlap=8)
    for _ in range(400):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 80)))
        assert np.frombuffer(chunked.ids(x), "<u4").tolist() == sp.encode(x), x
    assert chunked.spliced["splices"] > 30


@pytest.mark.parametrize("unit", [" word and another", "日本語の文。\n", "日本語", "x", " ", "<|endoftext|> so", "a\n\n  b"])
def test_huge_texts_at_the_default_chunk(library, unit):
    x = unit * (150_000 // len(unit))
    e = bpe.Encoder(BYTE_BPE)
    assert e.ids(x) == np.array(library(x), "<u4").tobytes()
    if len(set(unit)) > 3:
        assert e.spliced["splices"] == 2


def test_token_counts(docs, nothing, library):
    got = token_counts.count_tokens(docs, BYTE_BPE, 20, chunk=500, overlap=16).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i is None, i or 0, len((t or "").encode()), len(library(t)), len(library(t)) > 20) for i, t, _, _ in ROWS)
    assert token_counts.count_tokens(nothing, BYTE_BPE).count() == 0
    assert token_counts.count_tokens(docs, PIECES).count() == len(ROWS)


def test_served_is_fair_and_monotone():
    totals, weights = [700, 50, 0, 250, 3], [7, 5, 1, 2, 3]
    order = sorted(((2 * k + 1) / weights[s], s) for s in range(5) for k in range(totals[s]))
    for n in (0, 1, 2, 10, 99, 500, 800, 1003):
        want = [sum(1 for _, s in order[:n] if s == x) for x in range(5)]
        assert packing.served(n, totals, weights) == want


def test_packing(docs, nothing, library):
    got = packing.pack(docs, BYTE_BPE, length=64, window=4).collect()
    want = collections.Counter(np.array(library(t) + [0], "<u4").tobytes() for _, t, _, _ in ROWS)
    by_seq = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_seq[r.sequence_id].append((r.offset, r.length))
    for s, pieces in by_seq.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 64 or s == max(by_seq)
    whole = collections.Counter()
    for _, g in itertools.groupby(sorted((r for r in got if r.doc_id not in (3, None)), key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        whole[b"".join(bytes(r.ids) for r in g)] += 1
    assert not whole - want and sum(r.length for r in got) == sum(len(k) // 4 * n for k, n in want.items())
    shares = collections.Counter()
    for r in got:
        shares[r.source] += r.length
    total = sum(shares.values())
    for w, g in itertools.groupby(sorted(got, key=lambda r: r.window_id), key=lambda r: r.window_id):
        have = collections.Counter()
        for r in g:
            have[r.source] += r.length
        if sum(have.values()) == 256:
            assert all(abs(have[s] - 256 * n / total) < 2.5 for s, n in shares.items())
    assert packing.pack(nothing, BYTE_BPE).count() == 0
    uneven = packing.pack(docs, BYTE_BPE, length=64, window=4, weights={"s0": 1, "s3": 3}).collect()
    assert sum(r.length for r in uneven) == total
    tempered = packing.pack(docs, BYTE_BPE, length=64, window=4, temper=0.5).collect()
    assert sum(r.length for r in tempered) == total and all(abs(r.deficit) < 1.5 for r in tempered)
    aim = {s: n**0.5 for s, n in shares.items()}
    opened = collections.Counter()
    for r in tempered:
        if r.window_id == 0:
            opened[r.source] += r.length
    assert all(abs(opened[s] - 256 * a / sum(aim.values())) < 1.5 for s, a in aim.items())


# --- line dedup ---------------------------------------------------------------------------------------------


def plain_line_dedup(rows, min_lines=3, min_words=50):
    def windows(t):
        full = [(p, x) for p, x in enumerate(t.split("\n")) if x.encode().split()]
        for k in range(len(full)):
            for n in range(1, min_lines + 1):
                part = full[k : k + n]
                if len(part) == n and (n == min_lines or sum(len(x.encode().split()) for _, x in part) >= min_words):
                    yield [p for p, _ in part], tuple(x for _, x in part)
                    break

    order = sorted({(i is not None, i or 0, t) for i, t, *_ in rows if t is not None})
    first, gone = {}, collections.defaultdict(set)
    for i in order:
        for at, content in windows(i[2]):
            if content in first and first[content] != (i, at[0]):
                gone[i] |= set(at)
            first.setdefault(content, (i, at[0]))
    return {i: "\n".join(x for p, x in enumerate(i[2].split("\n")) if p not in gone[i]) for i in order}


def test_line_dedup(spark, docs, nothing):
    got = line_dedup.dedup_lines(docs, report=True).collect()
    want = plain_line_dedup(ROWS)
    assert len(got) == len(ROWS) and set(docs.columns) <= set(got[0].asDict())
    pairs = collections.Counter((r.doc_id, r.text) for r in got)
    assert pairs == collections.Counter((i, None if t is None else want[i is not None, i or 0, t]) for i, t, *_ in ROWS)
    assert any(r.n_removed for r in got) and all(r.row == 2 and r.pos == 3 for r in got)
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert not [c for c in line_dedup.dedup_lines(docs)._jdf.queryExecution().toString().split() if "Python" in c or "Arrow" in c]


def test_line_dedup_extends_to_the_run_s_ends(spark):
    def line(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    r = random.Random(5)
    pool = [line(f"l{k}_", n) for k, n in enumerate([60, 55, 40, 30, 25, 20, 20, 10, 10, 5, 1, 1])]
    rows = [(0, line("a", 60) + "\n" + line("b", 20)), (1, line("c", 60) + "\n\n" + line("b", 20)), (2, line("a", 60) + "\n" + line("b", 20) + "\n" + line("d", 9)), (3, line("c", 60) + "\n" + line("b", 20))]
    rows += [(10 + k, "\n".join([*(r.choice(pool) for _ in range(r.randint(1, 9)))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()}
    assert got[2] == line("d", 9) and got[3] == ""
    seen, want = {}, {}
    for i, t in rows:
        full = [(p, x) for p, x in enumerate(t.split("\n")) if x.split()]
        gone = set()
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                run = tuple(x for _, x in full[a:b])
                if len(run) >= 3 or sum(len(x.split()) for x in run) >= 50:
                    if seen.setdefault(run, (i, a)) < (i, a):
                        gone |= {p for p, _ in full[a:b]}
        want[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    assert got == want
    assert [x for x in line_dedup.dedup_lines(df, extend=False).collect() if x.text != want[x.doc_id]]


# --- simhash --------------------------------------------------------------------------------------------------


def plain_fingerprint(t, size=3):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(keys, linked):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(list(keys), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(docs, nothing):
    got = simhash.near_duplicates(docs, shard_rows=8).collect()
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in ROWS]
    groups = closure({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    want = collections.Counter((i, f"{p:016x}", least.get(groups[p])) for i, p in prints)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_vantage_point_trees_lose_no_link(spark):
    g = np.random.default_rng(1)
    codes = []
    for _ in range(150):
        x = int(g.integers(0, 1 << 63))
        for _ in range(8):
            codes.append(x)
            for _ in range(int(g.integers(1, 3))):
                x ^= 1 << int(g.integers(64))
    codes = np.unique(np.array(codes, np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(c),) for c in codes], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 2, shard_rows=60)).collect()}
    want = closure([int(c) for c in codes], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {int(c): roots.get(int(c), int(c)) for c in codes} == want


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_keep_one(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)  # blocks are dealt out as pairs of parts
    base = [text(60) for _ in range(4)]
    rows = list(ROWS) + [(1000 + k, " ".join(w if j != 7 * (k % 9) else "changed" for j, w in enumerate(base[k % 4].split())), "a", "s0") for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    got = {r.doc_id for r in simhash.keep_one(df).collect()}
    named = {i: shingles(t) for i, t, *_ in rows if i is not None}
    words = {i: tuple((t or "").encode().lower().split()) for i, t, *_ in rows if i is not None}
    similar = lambda a, b: words[a] == words[b] or (named[a] and len(named[a] & named[b]) / len(named[a] | named[b]) >= 0.8)
    groups = closure(named, similar)
    assert got == {i for i, r in groups.items() if i == r} | {None}
    assert simhash.keep_one(nothing).count() == 0


def test_keep_one_finds_repeated_phrases_and_judges_far_fingerprints(spark):
    rows = []
    for k in range(20):
        words = [f"w{k}x{j}" for j in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + [f"p{k}x{j}" for j in range(7)] * 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(range(0, 40, 2))
    copies, roots = simhash.similar_groups(df, radius=0)  # the tree alone joins nothing
    assert copies.count() == 0 and roots.where("node <> root").count() == 20


def test_keep_one_compares_whole_sets_of_long_texts(spark):
    rows, want = [], set()
    for k in range(40):  # 596 shingles; 62 words changed: 530 of 662 common (0.801), 63: 529 of 663 (0.798)
        words = [f"w{k}x{j}" for j in range(600)]
        n = 62 + k % 2
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:200] + [f"c{k}x{j}" for j in range(n)] + words[200 + n :]))]
        want |= {2 * k, 2 * k + 1} if k % 2 else {2 * k}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want


# --- suffix arrays --------------------------------------------------------------------------------------------


def test_suffix_array():
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        sa = suffix_dedup.suffix_array(s, 5)
        assert sa == sorted(range(len(s)), key=lambda k: s[k:])
        plcp = suffix_dedup.common_prefixes(s, sa)
        for a, b in zip(sa, sa[1:]):
            k = 0
            while a + k < len(s) and b + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert plcp[b] == k


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix_dedup(docs, nothing, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    size, count, raws = 100, collections.Counter(), [(i, (t or "").encode()) for i, t, *_ in ROWS]
    for _, r in raws:
        count.update(r[k : k + size] for k in range(len(r) - size + 1))
    want = collections.Counter()
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - size + 1):
            if count[r[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(r)) if gone[k] and not (k and gone[k - 1]))
        want[i, len(r), sum(gone), spans, bytes(x for x, g in zip(r, gone) if not g)] += 1
    got = suffix_dedup.remove_repeats(docs, size).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert suffix_dedup.remove_repeats(nothing, size).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated(docs, 50)


def test_op8_returns_the_text_that_is_left(spark, tmp_path):
    words = [f"w{k:05d}" for k in range(400)]
    long, short = " ".join(words[:60]), " ".join(words[60:115])  # 419 and 384 bytes; both over 50 words
    split = "x" * 400 + "é", "x" * 400 + "è"  # C3 A9 and C3 A8: 401 bytes in common
    texts = [f"one {long} end", f"two {long} fin", f"three {short} end", f"four {short} fin", "clean " + " ".join(words[200:300]), None, *split]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[k].text for k in range(8)] == ["oneend", "twofin", *texts[2:5], "", "\ufffd", "\ufffd"]
    assert [got[k].n_bytes for k in range(8)] == [len((t or "").encode()) for t in texts]
    assert got[6].kept_sha256 == hashlib.sha256(b"\xa9").hexdigest()


def test_anchors_are_those_of_each_window_wherever_a_piece_ends(monkeypatch):
    raw, size = "".join(rng.choice("ab é") for _ in range(3000)).encode(), 100

    def of_windows():
        return {x: (h, p) for h, p, i, j in suffix_dedup.anchors(raw, size) for x in range(i, j + 1)}

    whole = of_windows()
    assert sorted(whole) == list(range(len(raw) - size + 1))
    for piece in (1, 64, 333):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        assert of_windows() == whole


# --- searches -------------------------------------------------------------------------------------------------


def test_nearest(spark):
    g = np.random.default_rng(2)
    centre = g.standard_normal((8, 16))
    v = (centre[g.integers(0, 8, 600)] + 0.3 * g.standard_normal((600, 16))).astype(np.float32)
    rows = [(k, [float(x) for x in v[k]], "x") for k in range(600)] + [(600 + k, [float(x) for x in v[0]], "x") for k in range(40)]
    odd = [(700, None, "x"), (701, [0.0] * 16, "x"), (702, [float("nan")] * 16, "x"), (703, [1.0], "x"), (704, [None] * 16, "x"), (None, [1.0] * 16, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, p string")
    got = projections.nearest(df, df.where("vec_id % 50 = 0 or vec_id is null"), k=5, cell=100).collect()
    unit = np.array([r[1] for r in rows]) / np.linalg.norm([r[1] for r in rows], axis=1)[:, None]
    hits = total = 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == {k for k in range(640) if k % 50 == 0}
    for q, found in by.items():
        cos = unit @ unit[q]
        best = sorted((k for k in range(640) if k != q), key=lambda k: (-round(cos[k], 12), k))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(s - cos[i]) < 1e-12 for _, i, s in found)
        hits += len(set(best) & {f[1] for f in found})
        total += 5
    assert hits / total >= 0.9
    assert [f[1] for f in by[0]] == [600, 601, 602, 603, 604]  # copies: ties to the smaller id
    assert projections.nearest(df.where("vec_id in (0, 1)"), df.where("vec_id = 0")).count() == 1
    assert projections.nearest(df.where("false"), df).count() == 0


def test_nearest_scales_norms_and_settles_repeated_ids(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [5.0, 5.0]), (3, [1.0, -1.0]), (4, [float("inf"), 1.0]), (0, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = projections.nearest(df, df.where("vec_id in (0, 2)"), k=2, m=8).collect()
    found = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in got}
    assert found[2, 1] == (0, 1.0) and found[2, 2] == (1, round(3 / 10**0.5, 9))
    assert {v for (q, _), (v, _) in found.items() if q == 0} <= {1, 2, 3} and all(r.verified >= 1 for r in got)


@pytest.mark.parametrize(("shard", "block"), [(64, 5), (4096, 4096), (3, 4096)])
def test_hamming(spark, shard, block):
    g = np.random.default_rng(3)
    codes = [int(x) for x in g.integers(0, 1 << 62, 300)]
    rows = [(k, codes[k % 290] ^ (1 << k % 60 if k % 3 else 0)) for k in range(400)] + [(500 + k, codes[0]) for k in range(30)] + [(5, codes[5]), (None, 1), (999, None)]
    df = spark.createDataFrame([(i, c, 1) for i, c in rows], "vec_id long, code long, ids int")
    got = multi_index.hamming_top_k(df, df.where("vec_id % 20 = 0"), k=4, shard_rows=shard, block=block).collect()
    real = sorted({(i, c) for i, c in rows if i is not None and c is not None})
    want = set()
    for q, c in ((i, c) for i, c in real if i % 20 == 0):
        best = sorted(((c ^ d).bit_count(), i) for i, d in real if i != q)[:4]
        want |= {(q, k + 1, i, d) for k, (d, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert multi_index.hamming_top_k(df.where("false"), df).count() == 0


# --- mixing, toxicity, scoring --------------------------------------------------------------------------------


def test_mixing(docs, nothing):
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    tokens = F.regexp_count("text", F.lit(r"\S+"))
    got = mixing.calibrated(docs, dims, tokens, power=0.5, rounds=50).collect()
    assert len(got) == len(ROWS)
    raked, share = collections.Counter(), collections.Counter()
    for r in got:
        raked[r.source] += r.tokens * r.weight
        share[r.source] += r.tokens
    total = sum(share.values())
    goal = {s: (n / total) ** 0.5 for s, n in share.items() if n}
    for s, x in goal.items():
        assert abs(raked[s] / sum(raked.values()) - x / sum(goal.values())) < 0.02
    table = mixing.calibrated(docs, dims, tokens, power=0.5, rounds=3, cells_on_driver=0).collect()
    small = mixing.calibrated(docs, dims, tokens, power=0.5, rounds=3).collect()
    key = lambda r: (r["row"]["doc_id"] is None, r["row"]["doc_id"] or 0)
    assert all(abs(a.weight - b.weight) < 1e-9 and a.kept == b.kept for a, b in zip(sorted(table, key=key), sorted(small, key=key)))
    assert all(r.kept for r in got if not r.tokens) and mixing.calibrated(nothing, dims, tokens).count() == 0


def test_toxicity_on_held_out_rows(spark, docs, nothing):
    bad = ["grumble", "vilenik", "vilenor", "stinker"]
    rows = []
    for k in range(600):
        toxic = k % 5 == 0
        rows.append((k, text(30) + (" " + rng.choice(bad) + "." if toxic else ""), int(toxic), int(k % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    chain = toxicity.fit(df, df.where("doc_id < 400").drop("text"), ["quality", "toxic"])
    got = {r.doc_id: r.p_toxic for r in toxicity.score(df, chain, ["quality", "toxic"]).collect()}
    right = [(got[k] >= 0.4) == bool(t) for k, _, t, _ in rows if k >= 400]
    assert sum(right) / len(right) >= 0.98
    kept = toxicity.drop_toxic(docs, chain, 1)
    assert kept.count() == len(ROWS) and kept.columns == docs.columns
    assert toxicity.score(nothing, chain, ["quality", "toxic"]).count() == 0
    none = toxicity.fit(docs, df.where("false").drop("text"), ["toxic"])
    assert toxicity.drop_toxic(docs, none, 0).count() == len(ROWS)


def test_later_models_see_out_of_fold_logits(monkeypatch):
    g, seen, real = np.random.default_rng(5), [], toxicity.Linear
    sizes = np.full(80, 12)
    rows = toxicity.Rows(g.integers(0, 30, 960), sizes, [f"w{k}" for k in range(30)])
    y = np.column_stack([g.integers(0, 2, 80), g.integers(0, 2, 80)]).astype(float)

    def recorded(part, before, labels):
        seen.append(before)
        return real(part, before, labels)

    monkeypatch.setattr(toxicity, "Linear", recorded)
    toxicity.Chain(rows, y, folds=4)
    want = np.zeros(80)
    for f in range(4):
        out = np.arange(80) % 4 == f
        model = real(rows.take(np.flatnonzero(~out)), np.zeros((60, 0)), y[~out, 0])
        want[out] = model.logits_of(rows.take(np.flatnonzero(out)), np.zeros((20, 0)))
    assert np.allclose(seen[-1][:, 0], want)


def test_toxicity_takes_the_least_of_repeated_texts(spark):
    df = spark.createDataFrame([(k, f"good {text(5)}" if k % 2 else f"bad {text(5)}") for k in range(60)] + [(1, "zzz")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(60)], "doc_id long, toxic int")
    chain = toxicity.fit(df, labels, ["toxic"])
    assert "zzz" not in chain.models[0].weights
    assert toxicity.drop_toxic(df, chain, 0).where("text like 'bad %'").count() == 0


def test_lattice_sums_over_all_segmentations():
    sp, plain, byte = lattice.vocabulary(PIECES)
    g = np.random.default_rng(4)
    logs = np.log(g.dirichlet(np.ones(sp.get_piece_size())))
    x = lattice.Lattice(PIECES, logs)
    for word in (b"the", b"hello", "naïve".encode(), "日本語x".encode(), b"aaaaaa"):
        s = "▁" + word.decode()

        def total(at):
            if at == len(s):
                return 1.0
            return sum(math.exp(lp) * total(e) for e, lp, _ in x.arcs(s, at))

        assert abs(x.word(word) - math.log(total(0))) < 1e-9
        uses = np.zeros(sp.get_piece_size())
        x.expected(word, 1.0, uses)
        spelled = sum(uses[i] * len(p) for p, i in plain.items())
        assert spelled <= len(s) + 1e-6


@pytest.mark.parametrize("frequent", [5, 1000])
def test_likelihood(docs, nothing, frequent):
    got = lattice.likelihood(docs, PIECES, frequent=frequent).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split()
    train = [words(t) for i, t, *_ in ROWS if not held(i)]
    c = collections.Counter(w for x in train for w in x)
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        base = math.log10((ends + 0.1) / (n + 0.1 * (v + 1))) + sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
        want[i, held(i), len(words(t)) + 1, 1 + sum(c[w] > 0 for w in words(t)), n, round(base, 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.likelihood(nothing, PIECES).count() == 0


def test_likelihood_of_whole_texts_by_enumeration(spark, monkeypatch):
    kept, real = [], lattice.piece_logs
    monkeypatch.setattr(lattice, "piece_logs", lambda *a, **b: kept.append(real(*a, **b)) or kept[-1])
    bits = ["to", "ta", "日", "né", "abc", "cab"]
    rows = [(k, " ".join(rng.choice(bits) + rng.choice(["", "s", "ed"]) for _ in range(1 + k % 7)), "xy"[k % 2]) for k in range(40)] + [(50, None, "x"), (51, "unseen wörd", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in lattice.likelihood(df, PIECES, frequent=4).collect()}
    held, words = (lambda i: zlib.crc32(str(i).encode()) % 10 == 0), (lambda t: (t or "").lower().split())
    c = {z: collections.Counter(w for i, t, g in rows if g == z and not held(i) for w in words(t)) for z in "xy"}
    ends = {z: sum(1 for i, _, g in rows if g == z and not held(i)) for z in "xy"}
    total = {z: sum(c[z].values()) + ends[z] for z in "xy"}
    n, both = sum(total.values()), c["x"] + c["y"]
    new = min(0.5, max((sum(1 for k in both.values() if k == 1) + 1) / (n + 2), 1e-6))

    def spelled(x, s, at=0):
        return 1.0 if at == len(s) else sum(math.exp(lp) * spelled(x, s, e) for e, lp, _ in x.arcs(s, at))

    for i, t, _ in rows:
        sums = []
        for z, logs in zip("xy", kept[-1]):
            x = lattice.Lattice(PIECES, logs)
            p = (0.8 * ends[z] / total[z] + 0.2 * sum(ends.values()) / n) * (1 - new) * (ends[z] + 0.5) / (sum(ends.values()) + 1)
            for w in words(t):
                p *= (1 - new) * (0.8 * c[z][w] / total[z] + 0.2 * both[w] / n) + new * spelled(x, "▁" + w)
            sums.append(p)
        assert abs(got[i] - math.log10(sum(sums))) < 1e-9


@pytest.mark.parametrize("cells", [mixing.CELLS, 0])
def test_mixing_by_budget_and_targets(spark, cells):
    rows = [(k, "w " * 50, "ab"[k % 3 == 0], f"s{k % 4}") for k in range(400)]
    dims = lambda d: {"source": d["source"], "lang": d["lang"]}
    tokens = F.regexp_count("text", F.lit(r"\S+"))
    share = {}
    for name, more in (("plain", []), ("rare", [(1000, "w " * 10, "zz", "rare")])):
        df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string")
        got = mixing.calibrated(df, dims(df), tokens, rounds=4 if cells else 1, cells_on_driver=cells, budget=0.7).collect()
        share[name] = sum(r.tokens * r.probability for r in got) / sum(r.tokens for r in got)
        assert all(0 <= r.probability <= 1 for r in got) and all(r.kept for r in got if r.source == "rare")
    assert abs(share["plain"] - 0.7) < 1e-6 and abs(share["rare"] - 0.7) < 1e-6
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.calibrated(df, dims(df), tokens, rounds=4 if cells else 1, cells_on_driver=cells, targets={"lang": {"a": 0.2, "b": 0.8, "none": 0.0}}, budget=0.3).collect()
    have = collections.Counter()
    for r in got:
        have[r.lang] += r.tokens * r.probability
    assert abs(have["b"] / sum(have.values()) - 0.8) < 1e-3 and abs(sum(have.values()) / 20000 - 0.3) < 1e-3


# --- the pipeline ---------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = text(80)
    rows = [(k, lines(3, 25) if k % 6 else base + f" tail{k}", "ab"[k % 2], f"s{k % 3}", 1) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == columns
        if name == "near_dedup":
            assert now.where("text like '% tail%'").count() == 1
    tokens = F.sum("length").alias("n")  # where pieces are cut depends on the order of rows, what is packed does not
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(tokens).first().n == now.agg(tokens).first().n > 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path, library):
    """Each stage against its plain version, on what the one before kept: nulls, empties, repeats, a long text, other columns."""
    import corpus_pipeline

    base = text(80)
    rows = [*ROWS, *((300 + k, base + f" tail{k}", "a", "s0") for k in range(5)), *((400 + k, "awful " * (k + 1) + text(20), "a", "s1") for k in range(40)), (500, "\n".join(text(30) for _ in range(600)), "b", "s2")]
    docs = spark.createDataFrame([(i, t, g, s, 1, "x", 2, 3, "w", "y") for i, t, g, s in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(400 <= i < 440), int(400 <= i < 440)) for i, *_ in rows if i is not None] + [(None, 1, 1), (9999, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    same = lambda got, want: collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(want)
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), [(i, t) for i, t, *_ in rows]

    chain = toxicity.fit(now, spark.read.parquet(str(tmp_path / "labels.parquet")), ["quality", "toxic"])
    kept = [(i, t) for i, t in kept if chain.probabilities([toxicity.features(t)])[0, 1] < 0.4]
    assert not [i for i, _ in kept if i is not None and 400 <= i < 440] and len(kept) > len(rows) - 45
    now = corpus_pipeline.toxicity(spark, now, str(tmp_path)).cache()
    assert same(now.collect(), kept) and now.columns == docs.columns

    plain = plain_line_dedup(kept)
    kept = [(i, None if t is None else plain[i is not None, i or 0, t]) for i, t in kept]
    now = corpus_pipeline.line_dedup(spark, now, str(tmp_path)).cache()
    assert same(now.collect(), kept) and all(r.n_chars == len(r.text or "") for r in now.collect())

    words = collections.defaultdict(set)
    for i, t in kept:
        words[i].add(t)
    named = {i: frozenset().union(*(shingles(t) for t in ts)) for i, ts in words.items() if i is not None and len(ts) == 1}
    equal = {i: tuple((min(words[i], key=str) or "").encode().lower().split()) for i in named}
    groups = closure(named, lambda a, b: equal[a] == equal[b] or (named[a] and len(named[a] & named[b]) / len(named[a] | named[b]) >= 0.8))
    now = corpus_pipeline.near_dedup(spark, now, str(tmp_path)).cache()
    left = collections.Counter(r.doc_id for r in now.collect())
    assert {i for i in left if i in named} == {i for i, r in groups.items() if i == r} and left[None] == sum(i is None for i, _ in kept)
    assert len([i for i in left if i is not None and 300 <= i < 305]) == 1

    fitted = corpus_pipeline.mixed(now, corpus_pipeline.MIX_BUDGET).collect()
    draw = lambda i: int(hashlib.md5(f"{'' if i is None else i}:3".encode()).hexdigest()[:8], 16) / 2**32
    want = collections.Counter((r["row"].doc_id, r["row"].text) for r in fitted if r.tokens == 0 or draw(r["row"].doc_id) < r.probability)
    share = sum(r.tokens * r.probability for r in fitted) / sum(r.tokens for r in fitted)
    now = corpus_pipeline.mixing(spark, now, str(tmp_path)).cache()
    assert same(now.collect(), want) and abs(share - corpus_pipeline.MIX_BUDGET) < 1e-6

    packed, tokens = corpus_pipeline.packing(spark, now, str(tmp_path)).collect(), collections.Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    want = collections.Counter()
    for r in now.collect():
        want[r.doc_id] += len(library(r.text)) + 1
    assert tokens == want
    assert sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sum(want.values())


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

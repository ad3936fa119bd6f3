"""The thin queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lattice import likelihood
from .line_dedup import dedup_lines
from .mixing import calibrated
from .multi_index import hamming_top_k, sign_code
from .packing import pack
from .projections import nearest
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import fit, score

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector: 32 projections, chi-square test at 0.9."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), k=5, m=32, p=0.9)


def op2_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of the embeddings as 64-bit codes; queries: ids divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return hamming_top_k(rows, rows.where("vec_id % 20 = 0"), k=10, parts=4)


OP2_SQL = """
WITH bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 64),
codes AS (SELECT DISTINCT vec_id, array_to_string(b[1:64], '')::BIT AS code FROM bits),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

N_WORDS = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """The corpus has no topic column: tables, and prose by its length, stand in for topics."""
    words = F.regexp_count(text, F.lit(N_WORDS))
    return F.when(F.contains(text, F.lit(" | ")), "table").when(words >= 400, "long").when(words >= 100, "medium").otherwise("short")


#: Target token shares of the languages in op3_mixing; sources and topics aim at their own shares to the power 0.9.
LANGUAGES = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
#: The part of the tokens that the mixed sample shall have.
MIX_BUDGET = 0.7


def mixed(docs: DataFrame, budget: float | None = None, targets: dict[str, dict] | None = None) -> DataFrame:
    dims = {"source": docs["source"], "lang": docs["lang"], "topic": topic_of(docs["text"])}
    return calibrated(docs, dims, tokens=F.regexp_count(docs["text"], F.lit(N_WORDS)), power=0.9, rounds=10, seed=3, budget=budget, targets=targets)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token weight and sampling probability: languages raked to LANGUAGES, MIX_BUDGET of the tokens."""
    out = mixed(table(spark, sf_dir, "documents"), MIX_BUDGET, targets={"lang": LANGUAGES})
    return out.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def _op3_sql() -> str:
    """Raking as 30 steps; then the same with full cells, which the least tokens for their weight make first.

    In that order a cell is full if what the cells before it leave, shared among it and those after it, is more
    than its tokens; the factor of the others is the largest that this gives to one which is not full.
    """
    names = ("source", "lang", "topic")
    steps, last = [], "start"
    for k in range(30):
        d = names[k % 3]
        steps.append(f"s{k} AS MATERIALIZED (SELECT source, lang, topic, tokens, g_source, g_lang, g_topic, w * g_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM {last})")
        last = f"s{k}"
    fitted = last
    budget = f"{MIX_BUDGET} * (SELECT sum(tokens) FROM cells)"
    for d in names:
        before = "ORDER BY supply / g, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        after = "ORDER BY supply / g, v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
        steps += [
            f"v_{d} AS (SELECT {d} AS v, any_value(g_{d}) AS g, sum(CASE WHEN w > 0 THEN tokens ELSE 0 END) AS supply FROM {fitted} GROUP BY {d})",
            f"m_{d} AS (SELECT *, greatest({budget} - coalesce(sum(supply) OVER ({before}), 0), 0) / sum(g) OVER ({after}) AS m FROM v_{d} WHERE g > 0)",
            f"p_{d} AS MATERIALIZED (SELECT v, least(supply, coalesce(g * (SELECT max(m) FROM m_{d} WHERE m * g <= supply), supply)) AS p FROM v_{d})",
        ]
    steps.append(f"c0 AS MATERIALIZED (SELECT source, lang, topic, tokens, w, w AS u FROM {fitted})")
    for k in range(30):
        d = names[k % 3]
        before = f"PARTITION BY {d} ORDER BY tokens / nullif(u, 0) NULLS LAST, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        after = f"PARTITION BY {d} ORDER BY tokens / nullif(u, 0) NULLS LAST, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
        steps += [
            f"f{k} AS (SELECT c.*, greatest(p - coalesce(sum(tokens) OVER ({before}), 0), 0) / nullif(sum(u) OVER ({after}), 0) AS f FROM c{k} c JOIN p_{d} ON {d} = v)",
            f"c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w, coalesce(u * max(CASE WHEN u * f <= tokens * (1 + 1e-12) THEN f END) OVER (PARTITION BY {d}), tokens) AS u FROM f{k})",
        ]
    stated = "CASE WHEN sum(tokens) > 0 THEN CASE lang " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in LANGUAGES.items()) + " ELSE 0.0 END ELSE 0.0 END::DOUBLE"
    aims = {d: stated if d == "lang" else "pow(sum(tokens) / (SELECT sum(tokens) FROM cells), 0.9)" for d in names}
    powers = ", ".join(f"(SELECT {d}, {aim} AS g_{d} FROM cells GROUP BY {d}) AS {d}s" for d, aim in aims.items())
    joins = " AND ".join(f"c.{d} = {d}s.{d}" for d in aims)
    scaled = ", ".join(f"{d}s.g_{d} / (SELECT sum(g) FROM (SELECT {aim} AS g FROM cells GROUP BY {d})) * (SELECT sum(tokens) FROM cells) AS g_{d}" for d, aim in aims.items())
    return rf"""
WITH words AS (
  SELECT doc_id, source, lang, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM documents
), docs AS (
  SELECT doc_id, source, lang, tokens, CASE WHEN contains(text, ' | ') THEN 'table' WHEN tokens >= 400 THEN 'long' WHEN tokens >= 100 THEN 'medium' ELSE 'short' END AS topic FROM words
), cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL
), start AS (SELECT c.source, c.lang, c.topic, c.tokens, {scaled}, c.tokens AS w FROM cells c, {powers} WHERE {joins}
), {", ".join(steps)}, fitted AS (SELECT source, lang, topic, w / tokens AS weight, least(u, tokens) / tokens AS probability FROM c30)
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens::BIGINT AS tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
       (tokens = 0 OR ('0x' || substr(md5(doc_id::VARCHAR || ':3'), 1, 8))::BIGINT / 4294967296.0 < probability) AS kept
FROM docs d JOIN fitted f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of 50 words or 3 lines that stand earlier go; one row per document."""
    return dedup_lines(table(spark, sf_dir, "documents"), min_lines=3, min_words=50, report=True).select("doc_id", "text", "n_lines", "n_removed", "n_runs")


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos - 1 AS pos, ls[pos] AS line, len(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
), full_lines AS (
  SELECT *, lead(words, 1) OVER w AS words2, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3,
         lead(words, 2) OVER w AS words3, lead(pos, 1) OVER w AS pos2, lead(pos, 2) OVER w AS pos3
  FROM lines WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  -- the fewest lines from a first one on
  SELECT doc_id, pos,
         CASE WHEN words >= 50 THEN [line] WHEN words + words2 >= 50 THEN [line, line2] WHEN line3 IS NOT NULL THEN [line, line2, line3] END AS content,
         CASE WHEN words >= 50 THEN [pos] WHEN words + words2 >= 50 THEN [pos, pos2] WHEN line3 IS NOT NULL THEN [pos, pos2, pos3] END AS covers
  FROM full_lines
  -- the fewest lines up to a last one, where they are not the fewest from their first
  UNION ALL SELECT doc_id, pos, [line, line2], [pos, pos2] FROM full_lines WHERE words >= 50 AND words2 < 50
  UNION ALL SELECT doc_id, pos, [line, line2, line3], [pos, pos2, pos3] FROM full_lines WHERE words + words2 >= 50 AND words2 + words3 < 50
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS nth FROM windows WHERE content IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest(covers) AS pos FROM ranked WHERE nth > 1
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < pos - 1) AS n_runs
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines,
       coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_runs, 0)::BIGINT AS n_runs
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN runs r ON r.doc_id = d.doc_id
"""


CATEGORIES = ["quality", "toxic"]


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of the chain; toxic from 0.4 on."""
    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    out = score(docs, chain, CATEGORIES)
    return out.withColumn("toxic", F.col("p_toxic") >= 0.4)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 1024 tokens; targets: the sources' token shares to the power 0.7."""
    packed = pack(table(spark, sf_dir, "documents"), tokenizer=BYTE_BPE, length=1024, temper=0.7)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window_id", "deficit")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked up to 2 differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes under a string of 400 bytes that starts anywhere else.

    n_bytes is the input's length; text is what is left, with U+FFFD where a cut falls inside a character.
    """
    out = remove_repeats(table(spark, sf_dir, "documents"), size=400)
    left = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), left)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; the limit is 512."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer=BYTE_BPE, limit=512)


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document: word unigrams, and the sum over all segmentations into pieces."""
    return likelihood(table(spark, sf_dir, "documents"), tokenizer=PIECES, rounds=1)


QUERIES = {f.__name__: f for f in (op1_nearest, op2_hamming, op3_mixing, op4_line_dedup, op5_toxicity, op6_packing, op7_simhash, op8_suffix_dedup, op9_token_counts, op10_lattice)}
ORACLES: dict[str, str] = {"op2_hamming": OP2_SQL, "op3_mixing": _op3_sql(), "op4_line_dedup": OP4_SQL}

"""The corpus pipeline: documents -> toxicity, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the
shared folder and reads it again as the next one's input, and deletes what the stage itself wrote on the way. All but
the last return the columns of documents. Null and empty texts, repeated rows, null ids, columns beyond those of
documents and empty tables are taken as each stage's operator states; all of these pass through to the packed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitstore.llm.common import stored, table
from pitstore.llm.line_dedup import dedup_lines
from pitstore.llm.packing import pack
from pitstore.llm.queries import BYTE_BPE, CATEGORIES, mixed
from pitstore.llm.simhash import keep_one
from pitstore.llm.toxicity import drop_toxic, fit
from pitstore.runtime import release, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return drop_toxic(docs, chain, CATEGORIES.index("toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; n_chars follows; every document keeps its row."""
    return dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the smallest id."""
    return keep_one(docs)


#: The part of the clean tokens that the mixed sample shall have.
MIX_BUDGET = 0.7


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of MIX_BUDGET of the tokens, in the target proportions of source, language and topic."""
    return mixed(docs, MIX_BUDGET).where("kept").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece of a document."""
    return pack(docs, tokenizer=BYTE_BPE, length=1024).drop("ids")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The first stage is a fitted model, which SQL cannot express; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark, keep=1)  # the stage is written whole: nothing reads its tables, nor its input, again
    return STAGES[-1][1](spark, docs, sf_dir)

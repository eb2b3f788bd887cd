"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the
columns of documents, and keep every row that they don't decide against.  Each stage's result is
written; the table before it and what the stage wrote on its way are deleted then.

Edge cases, in every stage: null and empty texts are kept (they are clean, have no windows and leak
nothing; of several, near-dedup keeps one); texts of any length are read whole; rows that repeat, or share
an id, or have none, are decided one by one; an empty table gives an empty result; columns beside those of
documents pass through whatever their names, but for the last stage, whose columns are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispark.llm import decontamination, line_dedup, packing, similar, simhash, toxicity
from clarispark.session import materialize, release, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the classifier is fitted on labels of documents that are here."""
    return toxicity.reject_toxic(docs, toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated line windows go from the texts; n_chars follows; no document goes."""
    cut = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word Jaccard of 0.8 or more) the document with the smallest doc_id stays, as one row."""
    return simhash.keep_one(docs, similar.near_duplicates)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go."""
    return decontamination.reject_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaked),
    ("best_fit_packing", pack),
]
#: No stage but line dedup can be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            written = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}", kept=True)
        release(docs)
        docs = written
    packed = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)  # packing has written the pieces it goes on from
    return packed

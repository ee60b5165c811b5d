"""A training-data pipeline: each stage is one operator of the llm subpackage, on all that the stage before kept.

A stage gets (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. `run` writes every stage's result as Parquet to the folder that spark.checkpoint.dir names
and reads it again as the next stage's docs.

Toxic documents go; later copies of repeated line runs go, and with them documents of which nothing but
blank lines is left; one document of each group of near copies stays (five-word shingles, similarity
0.8 or more); documents that hold a passage of the benchmark go; the rest is mixed to weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import op2_decontaminate, op3_mixing, op4_minhash, op9_toxicity, op10_line_dedup
from surveyspark.llm.common import OWN, load, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return op9_toxicity.ordinary_rows(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less later copies of repeated line runs, n_chars anew; those that lost all their words go."""
    out = op10_line_dedup.dedup_lines(docs)
    lost_all = (F.col(f"{OWN}n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(lost_all, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(f"{OWN}n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies, once if it is repeated, and all others; nulls are the largest ids."""
    return op4_minhash.kept_rows(docs, repeats=False)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return op2_decontaminate.clean_rows(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    return op3_mixing.mix(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("decontaminate", decontaminate), ("mixing", mixing)]

#: Trained and alignment stages cannot be written in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

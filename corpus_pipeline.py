"""Corpus pipeline over ``documents``: quality, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.llm import common as C
from dispatchlake.llm import decontam, dedup, packing, pii, quality
from dispatchlake.llm.queries import THRESHOLD



def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier doesn't reject, whatever their ids; null texts are judged as empty ones."""
    score = C.fresh("score", docs.columns)
    trees = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, trees, out=score).filter(F.col(score) >= THRESHOLD).drop(score)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies; documents without words are copies of nothing."""
    return dedup.keep_first(docs, width=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the new text. Null texts stay null."""
    out = pii.replace_entities(docs, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns]) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows; one row for each piece."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``.

    Each stage's intermediate tables go as soon as its result is written.
    """
    docs = C.prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with C.Scope(spark):
            docs = C.store(stage(spark, docs, sf_dir), f"stage-{name}", scoped=False)
    return STAGES[-1][1](spark, docs, sf_dir)

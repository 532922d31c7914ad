"""A corpus cleaned and encoded in five stages, each one an operator of tapewright.llm.

Every stage takes all that the one before kept; its table is written and read
again before the next.  All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import bpe, decontaminate, lines, minhash, quality
from tapewright.llm._spark import settle
from tapewright.llm.queries import vocabulary


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _columns(quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    kept = lines.dedup_lines(docs)
    return _columns(kept.withColumn("n_chars", F.char_length("text").cast("long")), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _columns(minhash.drop_near_duplicates(docs), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _columns(decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document; decoded tells whether they give its text back."""
    ranks, pattern = vocabulary()
    encoded = bpe.round_trip(docs, ranks, pattern)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The classifier can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

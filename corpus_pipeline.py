"""Corpus pipeline: stages over documents, each writing what it keeps for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import classifier, decontaminate, jaccard_join, line_dedup, mixing
from tidewater.llm._spark import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    scored = classifier.score_quality(docs, classifier.fitted(spark, docs.select("doc_id", "text"), sf_dir))
    return scored.filter(F.col("predicted") == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from the texts; documents stay, also where no line is left."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones, that with the smallest id; ids are the key of documents."""
    groups = jaccard_join.jaccard_components(docs)
    more = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(more, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that each document gives to the mix; documents of which it takes none go."""
    return mixing.mix_sources(docs).filter(F.col("taken") > 0)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier is trained; SQL can't express it.
ORACLE_SQL = None

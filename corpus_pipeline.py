"""The training-data pipeline: documents through five stages, each written as Parquet and read again.

Stages (all columns of documents stay until the last): documents that the quality rules reject go; lines that repeat
earlier ones go from the texts, n_chars following, and documents that have no words left by that go with them; of each
class of near duplicates one document stays, and one of all that never had words; documents with a benchmark passage go;
the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bagminhash, decontam, line_dedup, packing, quality_rules
from chronoweave.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rules fitted on the labels (of the rows not held out), applied to every document."""
    labels = table(spark, sf_dir, "labels").where(~quality_rules.held_out(F.col("doc_id")))
    model = quality_rules.train(docs, labels)
    return quality_rules.with_score(docs, model).where("predicted = 1").select(docs.columns)


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(docs, emptied=False)
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.without_near_duplicates(docs, one_wordless=True)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_duplicates), ("near_dedup", near_duplicates), ("decontamination", benchmark_leaks), ("packing", pack)]

#: No stage but the fourth can be put into SQL that ends in time; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

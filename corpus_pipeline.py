"""A training corpus from raw documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.checkpoints import ensure_checkpoint_dir
from reedbed.llm import exact_dedup, langid, near_dedup, packing, quality
from reedbed.llm.tables import table


def _passing(docs: DataFrame, passes) -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns whatever their names."""
    return docs.filter(passes)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept: their letters fit one of the learned languages."""
    return _passing(docs, langid.predictor(spark, langid.train(docs))(docs["text"])["accepted"])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with P(grade >= 1) of at least a half, by a model fitted on the labelled ones among them."""
    model = quality.train(quality.bounded(docs, table(spark, sf_dir, "labels")), quality.GRADES)
    return _passing(docs, quality.predictor(spark, model)(docs["text"])["keep"])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts. All columns pass, one named ``exact`` too."""
    with_group = exact_dedup.exact_dedup(docs.withColumnsRenamed({c: f"own {c}" for c in docs.columns}), text="own text", doc_id="own doc_id")
    return with_group.filter("exact.kept").drop("exact").withColumnsRenamed({f"own {c}": c for c in docs.columns})


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates. Rows that repeat identifier and text stay together: the stage before leaves one
    of them."""
    stay = near_dedup.near_classes(docs).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col("k_id")) & (F.xxhash64(docs["text"]) == F.col("k_hash")), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, each with its place in a sequence."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [("language", language), ("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]
#: SQL cannot express the learned models and the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{at}")
            docs = spark.read.parquet(f"{folder}/{at}")
    return docs

"""From raw documents to packed sequences: four stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id as languages
from tessera.llm import minhash, packing
from tessera.llm import toxicity as toxic
from tessera.llm.common import Scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxic.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxic.scorer(model)(F.col("text")) < F.lit(model.threshold))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language, or clearly in another than they say, go."""
    return docs.filter(languages.keeper(languages.train(docs))(F.col("text"), F.col("lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id; a text doesn't go for its id's sake."""
    return minhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    Near copies are gone by now: its clusters are of texts that share less, which stay but in sequences apart.
    """
    related = packing.near_clusters(docs, threshold=packing.RELATED)
    return packing.pack_documents(related, cluster_col="cluster", tokens=F.col("tokens"))


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("near_dedup", near_dedup), ("packing", pack)]

#: Trained models and star components aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

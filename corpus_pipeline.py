"""From raw documents to token ids: five stages, each written as Parquet and reread by the next.

Every stage but the last returns the columns of its input, whatever they are. Null and empty texts pass
the toxicity stage as clean, form one group in exact dedup, are linked with nothing by near dedup, and
have no ids; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from sensorloom.llm._common import fresh, materialise, table, text_hash

#: The mix of the pipeline: every document is unique by then, so none is taken twice.
MIX_EPOCHS = 1
MIX_SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    (own,) = fresh(docs.columns, "_score")
    return toxicity.score(docs, lexicon, score_col=own).where(F.col(own) < 0.5).drop(own)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles: its smallest doc_id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights of domains, languages and sources ask for."""
    key, own = fresh(docs.columns, "_id", "_hash")
    taken = mixing.mix(docs, budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS).where("epochs > 0")
    taken = materialise(taken.select(F.col("doc_id").alias(key), F.col("text_hash").alias(own)).distinct(), "pipeline-mix")
    return docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (text_hash(F.col("text")) == F.col(own)), "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    return byte_bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte bpe", encode),
]

#: SQL can't express the learned lexicon, the sketches and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return materialise(STAGES[-1][1](spark, docs, sf_dir), "stage-" + STAGES[-1][0].replace(" ", "-"))

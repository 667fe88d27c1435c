"""A training corpus from documents: good, exact and near copies out, mixed to target weights, tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, exact_dedup, minhash, mixing, quality
from tapeloom.llm.common import documents, materialise, small_batches
from tapeloom.llm.queries import bpe_codec

#: Target weights of the mixture. A document is taken once at most, and the first domain keeps all its tokens.
MIXTURE = {"good": 0.92, "poor": 0.03, "toxic": 0.05}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null text is scored as an empty one; repeated rows stay or go together; an empty table stays empty.
    """
    return quality.keep_good(docs, _labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each equal text: the one of most code points, then of the least id (null last), then stored first.

    Null and empty texts are equal; an empty table stays empty.
    """
    return exact_dedup.keep_first_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id (null last), then stored first.

    Texts without words are near only if equal; an empty table stays empty.
    """
    return minhash.keep_representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the domains' tokens to MIXTURE; each is taken once or not at all.

    Texts without words have the posteriors of the prior; repeated rows are drawn each; an empty table stays empty.
    """
    return mixing.take_mixture(docs, mixing.mix(docs, _labels(spark, sf_dir), MIXTURE, most=1.0))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text.

    A null text has no ids; repeated rows and null ids give a row each; an empty table gives none.
    Only doc_id and text are read, whatever other columns are called.
    """
    codec = bpe_codec(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    coded = small_batches(docs).select("doc_id", text.alias("text"), codec.both(text).alias("c")).select("doc_id", "text", "c.*")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.encode("text", "UTF-8")).alias("lossless"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encode_stage),
]

#: The classifiers, the signatures and the fitted rates are beyond SQL; a test holds run()'s rows against plain loops over its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Document quality by supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_sample, remainder, small_batches, trimmed
from .features import bags, mean_scores

SIZES, BITS, DIM = (3, 4), 16, 12
#: The bound on labelled documents of each class that are collected for training.
SAMPLE = 1500
KEEP = 0.7


def train_embeddings(texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """Hashed word and n-gram vectors, averaged per text, under a softmax of two classes, by numpy SGD.

    Returned as what scoring needs: for each bucket the difference of its two class logits, and
    the classes' difference of biases.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (2**BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    samples = bags(texts, SIZES, BITS)
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            ids, share = samples[i]
            step = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            err = p / p.sum()
            err[labels[i]] -= 1
            back = out @ err
            out -= step * np.outer(hidden, err)
            bias -= step * 0.1 * err
            vectors[ids] -= (step * len(ids) ** 0.5) * np.outer(share, back)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id"):
    """Train on at most about `sample` documents of each label, from rows whose crc32(doc_id) mod 4 is not 2.

    The texts of an id that repeats are told apart and bounded too. labels: doc_id, quality.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & (remainder("doc_id", 4) != 2)).select("doc_id", "quality").distinct()
    chosen = [hash_sample(known.filter(F.col("quality") == k), "doc_id", sample, "quality") for k in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most about 2 * sample rows
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = own.join(ids, "doc_id").dropDuplicates(["doc_id", "text", "quality"])
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy("doc_id", "quality").orderBy("text"))).filter("__i <= 4").drop("__i").toPandas()
    if rows["quality"].nunique() < 2:
        return np.zeros(2**BITS, np.float32), float(rows["quality"].mean() * 10 - 5) if len(rows) else 5.0
    rows = rows.sort_values(["doc_id", "text"])
    return train_embeddings(list(rows["text"]), rows["quality"].to_numpy())


def quality_score(spark: SparkSession, model: tuple[np.ndarray, float], text_col: str | F.Column = "text"):
    """A column of probabilities that a text is good, from whole texts; the model is of fixed size."""
    shared, bias = spark.sparkContext.broadcast(model[0]), model[1]

    @F.pandas_udf("double")
    @trimmed
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            z = mean_scores(list(texts), shared.value, SIZES, BITS) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return score(F.coalesce(text.cast("string"), F.lit("")))


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of docs.

    A null text counts as empty; a text without features gets the score of the bias alone. Rows
    that repeat are scored each; null ids count as not held out and are never learnt from. With
    labels of one class or none every row gets the same score (near 1 without labels). Only text
    is an input of the score. An empty table gives no rows.
    """
    spark = docs.sparkSession
    score = quality_score(spark, fit(spark, docs, labels, sample, text_col, id_col), text_col)
    scored = small_batches(docs).select(F.col(id_col).alias("doc_id"), (remainder(id_col, 4) == 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is KEEP or more.

    Null and empty texts count as empty and get the score of the bias alone; repeated rows stay or go
    together; ids that are null or repeat don't matter. Without labels every row stays, with labels of one
    class all stay or all go. An empty table stays empty, and columns of any name are carried along in a struct.
    """
    spark = docs.sparkSession
    score = quality_score(spark, fit(spark, docs, labels, sample, text_col), F.col("row").getField(text_col))
    scored = small_batches(docs).select(F.struct("*").alias("row")).withColumn("score", score)
    return scored.filter(F.col("score") >= KEEP).select("row.*")

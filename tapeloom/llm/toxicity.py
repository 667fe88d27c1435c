"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_rows, hash_sample, remainder, small_batches, trimmed
from .hashing import blocks, mix, words

BITS = 18
#: Bounds on the confirmed toxic and the unlabelled documents collected for training, and on the features kept.
POSITIVES, UNLABELLED, FEATURES = 2500, 5000, 512
TOXIC = 0.5


def present(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and word pair that a text has, once each, in text order."""
    word, offset = words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(offset))
    pair = mix(word[:-1] * np.uint64(3) + word[1:])[text[:-1] == text[1:]]
    owner = np.concatenate([text, text[:-1][text[:-1] == text[1:]]])
    bucket = (mix(np.concatenate([word, pair])) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique((owner << BITS) | bucket)
    return both >> BITS, both & (2**BITS - 1)


def _matrix(texts: list[str], chosen: np.ndarray) -> np.ndarray:
    column = np.full(2**BITS, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for lo, hi in blocks(texts):
        text, bucket = present(texts[lo:hi])
        c = column[bucket]
        x[text[c >= 0] + lo, c[c >= 0]] = 1
    return x


def choose_features(positive: list[str], unlabelled: list[str]) -> np.ndarray:
    """Buckets that far more confirmed texts have than unlabelled ones, by the z of two shares."""
    share = []
    for texts in (positive, unlabelled):
        n = np.zeros(2**BITS)
        for lo, hi in blocks(texts):
            n += np.bincount(present(texts[lo:hi])[1], minlength=2**BITS)
        share.append(n / max(len(texts), 1))
    a, b = share
    pooled = (a * len(positive) + b * len(unlabelled)) / max(len(positive) + len(unlabelled), 1)
    z = (a - b) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-6) * (1 / max(len(positive), 1) + 1 / max(len(unlabelled), 1)))
    z = np.where(a * len(positive) >= 3, z, 0)
    order = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(order[z[order] > 4.5])


def train_nnpu(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of positive and unlabelled rows, by Adam.

    The risk is prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) with the logistic loss.
    Where the second part falls below zero, which only overfitting does, the step goes up its slope.
    """
    w, b = np.zeros(p.shape[1]), -2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = -prior * sigmoid(-zp) / len(p), np.zeros(len(u))
        np_, nu = -prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)
        if negative >= 0:
            gp, gu = gp + np_, nu
        else:
            gp, gu = -np_, -nu
        g = np.append(p.T @ gp + u.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text"):
    """(weight of each bucket, bias), learnt from rows whose crc32(doc_id) mod 5 is not 0.

    The confirmed positives are labels' toxic rows; the class prior is their share among the
    labelled rows; the unlabelled rows are a hash sample of all documents, whose labels aren't read.
    """
    table = np.zeros(2**BITS, np.float32)
    known = labels.filter(remainder("doc_id", 5) != 0).select("doc_id", "toxic").distinct()
    prior = known.select(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    ids = F.broadcast(hash_sample(known.filter("toxic = 1").select("doc_id"), "doc_id", positives, "toxic"))  # at most about `positives` rows
    texts = docs.filter(remainder(id_col, 5) != 0).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = Window.partitionBy("doc_id").orderBy("text")  # of an id that repeats four texts at most
    p = texts.join(ids, "doc_id").distinct().withColumn("__i", F.row_number().over(one)).filter("__i <= 4").orderBy("doc_id", "text").toPandas()
    u = bounded_rows(texts.withColumn("all", F.lit(0)), "all", {0: texts.count()}, unlabelled, "unlabelled").sort_values(["doc_id", "text"])
    if not len(p) or not len(u) or not prior:
        return table, -5.0
    prior = min(max(prior, 1e-3), 0.9)
    p, u = list(p["text"]), list(u["text"])
    chosen = choose_features(p, u)
    if not len(chosen):
        return table, float(np.log(prior / (1 - prior)))
    w, b = train_nnpu(_matrix(p, chosen), _matrix(u, chosen), prior)
    table[chosen] = w
    return table, b


def toxicity_score(spark: SparkSession, model: tuple[np.ndarray, float], text_col: str = "text"):
    """A column of probabilities that a text is toxic, from whole texts; the model is of fixed size."""
    shared, bias = spark.sparkContext.broadcast(model[0]), model[1]

    @F.pandas_udf("double")
    @trimmed
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, z = list(batch), []
            for lo, hi in blocks(texts):
                text, bucket = present(texts[lo:hi])
                z.append(np.bincount(text, weights=shared.value[bucket], minlength=hi - lo) + bias)
            z = np.concatenate(z) if z else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of docs.

    A null text counts as empty and gets the score of the bias alone. Rows that repeat are scored
    each; null ids count as held out. Without confirmed toxic rows every score is near 0. Only text
    is an input of the score. An empty table gives no rows.
    """
    score = toxicity_score(docs.sparkSession, fit(docs, labels, id_col=id_col, text_col=text_col), text_col)
    scored = small_batches(docs).select(F.col(id_col).alias("doc_id"), (remainder(id_col, 5) == 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))

"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_rows, remainder, small_batches, trimmed
from .features import bags, mean_scores

SIZES, BITS = (1, 2, 3), 16
#: The bound on labelled documents of each language that are collected for training.
SAMPLE = 800
#: A lead of the best language's loss over the next below which a row is flagged as ambiguous.
LEAD = 0.5


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each class.

    Up to 6 classes: every split of the classes in two (an exhaustive code). Beyond: random
    balanced columns, 12 for each doubling of the classes, of several draws the one whose closest
    two rows differ most.
    """
    if classes <= 6:
        splits = np.arange(2 ** max(classes - 1, 0) - 1)
        code = np.array([[1] * len(splits), *[1 - 2 * (~(splits >> i) & 1) for i in range(classes - 1)]][:classes])
        return code.reshape(classes, -1)
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = np.stack([rng.permutation(np.resize([1, -1], classes)) for _ in range(int(12 * np.ceil(np.log2(classes))))], axis=1)
        gap = min(np.sum(code[i] != code[j]) for i in range(classes) for j in range(i))
        if gap > apart:
            best, apart = code, gap
    return best


def train_bits(texts: list[str], targets: np.ndarray, epochs: int = 4, rate: float = 0.5, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights (buckets, bits) and biases of one binary n-gram classifier a bit, by AdaGrad."""
    rng = np.random.default_rng(seed)
    bits = targets.shape[1]
    w, grown = np.zeros((2**BITS, bits), np.float32), np.full((2**BITS, bits), 1e-6, np.float32)
    bias, bias_grown = np.zeros(bits), np.full(bits, 1e-3)
    samples = bags([t.lower() for t in texts], SIZES, BITS)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            ids, share = samples[i]
            z = share @ w[ids] + bias
            err = -targets[i] / (1 + np.exp(np.clip(targets[i] * z, -30, 30)))
            g = np.outer(share, err).astype(np.float32)
            grown[ids] += g * g
            w[ids] -= rate * g / np.sqrt(grown[ids])
            bias_grown += err * err
            bias -= 0.1 * err / np.sqrt(bias_grown)
    return w, bias


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding: the class of the least summed logistic loss, its softmax share, its lead over the next."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None]).sum(axis=2)
    best = loss.argmin(axis=1)
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    ranked = np.sort(loss, axis=1)
    lead = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, 1 / share.sum(axis=1), lead


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(languages, codewords, weights, biases) from text and lang of rows whose crc32(doc_id) mod 3 is not 1."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col, 3) != 1))
    known = known.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return langs, np.ones((0, 1)), np.zeros((2**BITS, 1), np.float32), np.zeros(1)
    rows = bounded_rows(known, "lang", counts, sample, "language").sort_values(["doc_id", "text"])
    code = codewords(len(langs))
    if not code.shape[1]:
        return langs, np.ones((1, 1)), np.zeros((2**BITS, 1), np.float32), np.ones(1)
    number = {v: i for i, v in enumerate(langs)}
    w, bias = train_bits(list(rows["text"]), code[[number[v] for v in rows["lang"]]])
    return langs, code, w, bias


def identify_language(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for every row of docs.

    A null text, or one without a letter, is ``und`` with score 0 (and ambiguous); so is every row
    if no row has a language to learn. With one language to learn, every text with a letter gets
    it. All languages are learnt, each from about `sample` documents. Repeated rows are predicted each; an
    empty table gives no rows; null ids are learnt from and not held out. Other columns are not read. Only
    text is an input of the prediction.
    """
    spark: SparkSession = docs.sparkSession
    langs, code, w, bias = fit(docs, sample, id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast(w)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    @trimmed
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            known = np.array([bool(langs) and any(map(str.isalpha, t)) for t in texts], bool)
            if langs:
                best, share, lead = decode(mean_scores([t.lower() for t in texts], shared.value, SIZES, BITS) + bias, code)
            else:
                best, share, lead = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            names = np.array([*langs, "und"], object)[np.where(known, best, len(langs))]
            yield pd.DataFrame({"lang_pred": names, "score": np.where(known, share, 0.0), "ambiguous": ~known | (lead < LEAD)})

    found = small_batches(docs).select(F.col(id_col).alias("doc_id"), (remainder(id_col, 3) == 1).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p"))
    return found.select("doc_id", "held_out", "p.*")

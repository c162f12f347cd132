"""Quality by compression: two zstandard dictionaries, one from good and one from bad labelled text.

Text that resembles a dictionary's sources compresses better with it. Each whole text is cut into blocks of
`block` bytes, every block is compressed with each dictionary and with none, and the sums are divided by
the text's bytes. The normalised difference of the compressed sizes, its extremes over the blocks and
the normalised sizes themselves go into a logistic model, fitted on labelled rows that built no dictionary
and shifted to the shares of the classes among all learning labels, so the score is a probability.

Training takes at most `sample_rows` labelled rows of each class, the first by a hash of doc_id, and of a text at most
`sample_bytes` bytes, from a place drawn by that hash; scoring takes every row and every byte. Labels that contradict each other
for one doc_id, null labels and rows without doc_id teach nothing; of different texts of one doc_id the least teaches. With fewer than two labelled texts of either class nothing can be
told apart: the model is not `fitted`, and the score is the share of good labels (0.5 if none). A null or empty text is scored as a text of no bytes, and
an empty table gives no rows. Rows that repeat are scored each. Other columns keep their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, small_batches

BLOCK = 512
DICTIONARY_BYTES = 1 << 17
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 1 << 15
LEVEL = 3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    """dictionaries: none if the score is constant, which is then `constant`."""

    dictionaries: list[bytes]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float = 0.5

    @property
    def fitted(self) -> bool:
        return bool(self.dictionaries)


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in dictionaries] + [zstandard.ZstdCompressor(**plain)]


def features(text: bytes, tools: list[zstandard.ZstdCompressor], block: int) -> list[float]:
    """Of the sizes with the good dictionary, the bad one and none: difference, each size, extremes of the difference."""
    parts = [text[i : i + block] for i in range(0, len(text), block)]
    if not parts:
        return [0.0] * 6
    sizes = np.array([[len(c.compress(p)) for c in tools] for p in parts], float)
    n = np.fromiter(map(len, parts), float, len(parts))
    good, bad, none = sizes.sum(0) / len(text)
    apart = (sizes[:, 0] - sizes[:, 1]) / n
    return [good - bad, good, bad, none, apart.max(), apart.min()]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + penalty * w)
    return mean, scale, w


def fit(good: list[bytes], bad: list[bytes], n_good: int, n_bad: int, block: int = BLOCK, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """n_good, n_bad: learning labels of each class in all, for the classes' shares."""
    empty = np.zeros(0)
    if min(len(good), len(bad)) < 2:
        return Model([], empty, empty, empty, (n_good / (n_good + n_bad)) if n_good + n_bad else 0.5)
    sides = [(rows[: 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]) for rows in (good, bad)]
    dictionaries = []
    for build, _ in sides:
        parts = [t[i : i + block] for t in build for i in range(0, len(t), block)]
        try:
            dictionaries.append(zstandard.train_dictionary(dictionary_bytes, parts).as_bytes())
        except zstandard.ZstdError:  # too little text for the trainer: the text itself serves as one
            dictionaries.append(b"".join(parts)[-dictionary_bytes:])
    tools = compressors(dictionaries)
    x = np.array([features(t, tools, block) for _, rest in sides for t in rest])
    y = np.array([1 - k for k, (_, rest) in enumerate(sides) for _ in rest], float)
    mean, scale, weights = _logistic(x, y)
    weights[-1] += np.log(n_good / n_bad) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(dictionaries, mean, scale, weights)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    learning = labels.where(F.col("quality").isin(0, 1) & (crc_of_id() % folds != held_out))
    learning = learning.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    n = {r["quality"]: r["count"] for r in learning.groupBy("quality").count().collect()}
    picked = [learning.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "quality") for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionAll(picked[1]))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    spare = F.greatest(F.lit(0), F.octet_length(text) - sample_bytes)
    place = (F.pmod(F.xxhash64("doc_id"), spare + 1) + 1).cast("int")
    parts = docs.select("doc_id", F.substring(text, place, F.lit(sample_bytes)).alias("text"))
    rows = parts.join(chosen, "doc_id").where(F.octet_length("text") > 0).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id", kind="stable")
    side = {k: [bytes(t) for t in rows.loc[rows["quality"] == k, "text"]] for k in (0, 1)}
    return fit(side[1], side[0], n.get(1, 0), n.get(0, 0))


def score_batch(texts: list[bytes], model: Model, block: int = BLOCK) -> np.ndarray:
    if not model.dictionaries or not texts:
        return np.full(len(texts), model.constant)
    tools = compressors(model.dictionaries)
    x = np.array([features(t, tools, block) for t in texts])
    a = np.clip((x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1], -30, 30)
    return 1 / (1 + np.exp(-a))


def _score(model):
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_batch([bytes(t) if t is not None else b"" for t in texts], model.value))

    return F.pandas_udf(made, "double")


def score(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """docs with a column `name`, the probability that a row is good. A batch prepares the dictionaries once."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    udf = _score(spark.sparkContext.broadcast(model))
    return docs.withColumn(name, udf(F.col("text").cast("binary")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted, a row for each input row. A null doc_id counts as held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **how))
    held = F.coalesce(crc_of_id() % FOLDS == HELD_OUT, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))

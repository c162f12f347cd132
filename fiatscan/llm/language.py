"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of `WINDOW` bytes, every byte is read, and both directions run over each window.
The network labels every position; a document's probabilities are the mean of those of its positions.
It is trained in numpy by backpropagation through time, on the driver, on a bounded sample: at most
`sample_rows` learning rows of each language, the first by a hash of doc_id (in each of 64 parts of the hash, as many as hold
all of these but for odd chances), and at most
`windows_each` windows of each row, drawn from the whole text inside Spark. Every language of a learning row
with a text is learned. Prediction reads whole texts.

A gate is a clipped line, and input weights are one table row a byte, so a step is two small products
and a few sums over thousands of windows at once.

A null text, or one without a letter, is `und` with score 0. With no learning rows, every text is. An empty table gives no rows. Rows that repeat are
predicted each. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, small_batches

WINDOW = 64
HIDDEN = 8
SAMPLE_ROWS = 400
WINDOWS_EACH = 6
STEPS = 240
BATCH = 256
RATE = 0.02
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def _gates(x: np.ndarray, h: np.ndarray, u: np.ndarray, hidden: int) -> tuple[np.ndarray, ...]:
    """x: input part (update, reset, candidate) of a step. Returns update, reset, candidate, and the candidate's recurrent part."""
    a = h @ u
    gate = np.clip(0.25 * (x[:, : 2 * hidden] + a[:, : 2 * hidden]) + 0.5, 0, 1)
    z, r, part = gate[:, :hidden], gate[:, hidden:], a[:, 2 * hidden :]
    return z, r, np.tanh(x[:, 2 * hidden :] + r * part), part


def _pass(codes: np.ndarray, table: np.ndarray, u: np.ndarray, order: range, keep: bool) -> tuple[list, list]:
    """States by position (and what the backward pass needs) of one direction."""
    hidden = len(u)
    h = np.zeros((len(codes), hidden), table.dtype)
    states, kept = [None] * codes.shape[1], [None] * codes.shape[1]
    for t in order:
        z, r, n, part = _gates(table[codes[:, t]], h, u, hidden)
        if keep:
            kept[t] = (h, z, r, n, part)
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _back(codes: np.ndarray, u: np.ndarray, kept: list, order: range, outer: list, table_shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights, from the gradients of the states."""
    hidden = len(u)
    g_table, g_u = np.zeros(table_shape, u.dtype), np.zeros_like(u)
    carried = np.zeros_like(kept[0][0])
    for t in reversed(order):
        h, z, r, n, part = kept[t]
        d = carried + outer[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * ((z > 0) & (z < 1)) * 0.25
        d_r = d_n * part * ((r > 0) & (r < 1)) * 0.25
        d_x = np.concatenate([d_z, d_r, d_n], 1)
        d_a = np.concatenate([d_z, d_r, d_n * r], 1)
        np.add.at(g_table, codes[:, t], d_x)
        g_u += h.T @ d_a
        carried = d * z + d_a @ u.T
    return g_table, g_u


def gradients(codes: np.ndarray, labels: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over positions, and its gradients."""
    steps, hidden = codes.shape[1], len(w["uf"])
    ahead, astern = range(steps), range(steps - 1, -1, -1)
    f_states, f_kept = _pass(codes, w["xf"], w["uf"], ahead, True)
    b_states, b_kept = _pass(codes, w["xb"], w["ub"], astern, True)
    real = (codes > 0).astype(w["o"].dtype)
    real /= max(1.0, real.sum())
    g = {k: np.zeros_like(v) for k, v in w.items()}
    f_outer, b_outer, loss = [], [], 0.0
    for t in range(steps):
        both = np.concatenate([f_states[t], b_states[t]], 1)
        logits = both @ w["o"] + w["c"]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        weight = real[:, t]
        loss -= float((weight * np.log(p[np.arange(len(p)), labels] + 1e-12)).sum())
        p[np.arange(len(p)), labels] -= 1
        p *= weight[:, None]
        g["o"] += both.T @ p
        g["c"] += p.sum(0)
        d = p @ w["o"].T
        f_outer.append(d[:, :hidden])
        b_outer.append(d[:, hidden:])
    g["xf"], g["uf"] = _back(codes, w["uf"], f_kept, ahead, f_outer, w["xf"].shape)
    g["xb"], g["ub"] = _back(codes, w["ub"], b_kept, astern, b_outer, w["xb"].shape)
    return loss, g


def fit(codes: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    n = len(languages)
    shapes = {"xf": (256, 3 * hidden), "uf": (hidden, 3 * hidden), "xb": (256, 3 * hidden), "ub": (hidden, 3 * hidden), "o": (2 * hidden, n), "c": (n,)}
    w = {k: rng.normal(0, 0.3 if len(s) > 1 else 0, s).astype(np.float32) for k, s in shapes.items()}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for i in range(1, steps + 1):
        rows = rng.integers(0, len(codes), batch)
        _, g = gradients(codes[rows], labels[rows], w)
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        pace = rate * min(1.0, i / 20) * (1 - 0.9 * i / steps)
        for k in w:
            x = g[k] / max(1.0, size)
            first[k] = 0.9 * first[k] + 0.1 * x
            second[k] = 0.99 * second[k] + 0.01 * x * x
            w[k] -= (pace * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


def window_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, zero-padded, and the text of each. A zero byte in a text is read as 1."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    data = b"".join(t.replace(b"\0", b"\1").ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts, counts))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


def probabilities(texts: list[bytes], model: Model, at_once: int = 4096) -> np.ndarray:
    """Mean position probabilities of each text; zeros for a text without bytes."""
    w, n = model.weights, len(model.languages)
    hidden = len(w["uf"])
    codes, owner = window_codes(texts)
    at_once = max(64, min(at_once, at_once * 32 // max(n, 1)))  # many languages take as much memory as few
    total, length = np.zeros((len(texts), n)), np.zeros(len(texts))
    for start in range(0, len(codes), at_once):
        part = np.ascontiguousarray(codes[start : start + at_once].T)
        h = np.zeros((part.shape[1], hidden), np.float32)
        ahead = np.empty((WINDOW, part.shape[1], n), np.float32)
        for t in range(WINDOW):
            z, _, m, _ = _gates(w["xf"][part[t]], h, w["uf"], hidden)
            h = m + z * (h - m)
            np.matmul(h, w["o"][:hidden], out=ahead[t])
        h = np.zeros_like(h)
        found = np.zeros((part.shape[1], n), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            z, _, m, _ = _gates(w["xb"][part[t]], h, w["ub"], hidden)
            h = m + z * (h - m)
            p = np.exp(np.clip(ahead[t] + h @ w["o"][hidden:] + w["c"], -30, 30))
            p *= ((part[t] > 0) / p.sum(1))[:, None]
            found += p
        own = owner[start : start + at_once]
        for k in range(n):
            total[:, k] += np.bincount(own, found[:, k], len(texts))
        length += np.bincount(own, (part > 0).sum(0), len(texts))
    return total / np.maximum(length, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return text is not None and any(unicodedata.category(c)[0] == "L" for c in text)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    lettered = [has_letter(t) for t in texts]
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = probabilities([t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, lettered)], model)
    best = p.argmax(1)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)], np.where(lettered, p[np.arange(len(p)), best], 0.0).clip(0, 1)


def _draw(windows_each: int):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, lang, copy, text in zip(pdf["doc_id"], pdf["lang"], pdf["copy"], pdf["text"]):
                n = -(-len(text) // WINDOW)
                drawn = range(n) if n <= windows_each else np.random.default_rng([int(doc_id) % 2**64, n]).choice(n, windows_each, False).tolist()
                for at in drawn:
                    piece = bytes(text[at * WINDOW : (at + 1) * WINDOW])
                    out.append((doc_id, lang, copy, at, piece))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "copy", "at", "piece"])

    return made


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, windows_each: int = WINDOWS_EACH, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    learning = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % folds != held_out))
    learning = learning.where(F.octet_length(F.col("text").cast("binary")) > 0)
    salted = learning.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h"))
    within = Window.partitionBy("lang", F.pmod("_h", F.lit(64))).orderBy("_h", "doc_id")
    each = 26 + sample_rows // 64 * 2  # of a part that holds sample_rows / 64 of them on average
    least = salted.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= each)
    chosen = least.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_n") <= sample_rows).select("doc_id", "lang").distinct()
    texts = learning.select("doc_id", "lang", F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"])
    drawn = texts.mapInPandas(_draw(windows_each), "doc_id long, lang string, copy long, at long, piece binary")
    rows = drawn.dropDuplicates(["doc_id", "lang", "copy", "at"]).toPandas()
    if not len(rows):
        return Model([], {})
    rows = rows.sort_values(["lang", "doc_id", "copy", "at"], ignore_index=True)
    first = rows.groupby(["lang", "doc_id"])["copy"].transform("first")
    rows = rows[rows["copy"] == first]
    languages = sorted(set(rows["lang"]))
    codes, _ = window_codes([bytes(x) for x in rows["piece"]])
    labels = np.searchsorted(languages, rows["lang"].to_numpy())
    rng = np.random.default_rng(0)
    even = np.concatenate([rng.choice(np.flatnonzero(labels == k), max(1, len(labels) // len(languages))) for k in range(len(languages))])
    return fit(codes[even], labels[even], languages)


def _predict(model):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, score = predict(pdf["text"].tolist(), model.value)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": found, "score": score})

    return made


def identify(docs: DataFrame, **how) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score, a row for each input row. A null doc_id counts as held out."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    model = spark.sparkContext.broadcast(train(docs, **how))
    held = F.coalesce(crc_of_id() % FOLDS == HELD_OUT, F.lit(True))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInPandas(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")

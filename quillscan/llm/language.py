"""Operator 7: language ID. Sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader under an elastic-net penalty, then calibrated with a temperature.

Features are hashed n-grams (one to three code points) of the lower-cased whole text, in which every run of characters
that are not letters counts as one blank: term frequency times the inverse document frequency over all training
documents, scaled to unit length. Document frequencies cover every training document. The weights are fitted on the driver to a bounded
sample of labelled rows: about `max_train_rows` for each language, drawn by a stable hash of the id, of which a fifth
sets the temperature.

Defined results: an empty table gives no rows, and very long texts are read whole; a null text, or one without a letter, gets `und` with score 0. Rows with a null lang, or without a
letter, teach nothing. Without any teaching row every prediction is `und`. Repeated rows are predicted alike. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import crc_fold, unit_hash

_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str | None, bits: int) -> np.ndarray | None:
    """The counts of a whole text's hashed n-grams, or None when it has no letter."""
    words = _OTHER.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, words)):
        return None
    c = np.frombuffer(f" {words.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - bits)
    one = c * _MIX[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MIX[1] + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MIX[2] + c[2:]
    return np.bincount(np.concatenate([x * np.uint32(0x27D4EB2F) >> shift for x in (one, two, three)]), minlength=1 << bits)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # one row for each label, one column for each feature
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        at = np.flatnonzero(counts)
        v = counts[at] * self.idf[at]
        z = (self.weights[:, at] @ v / max(np.sqrt(v @ v), 1e-12) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.labels[k], float(p[k] / p.sum())


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, width: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on the softmax loss: (feature indices, values, class) -> sparse weights and biases. The last
    column is the bias, which isn't penalised."""
    z, n = np.zeros((classes, width + 1)), np.zeros((classes, width + 1))
    pen1, pen2 = np.full(width + 1, l1), np.full(width + 1, l2)
    pen1[width] = pen2[width] = 0

    def weights(at):
        zz = z[:, at]
        return np.where(np.abs(zz) <= pen1[at], 0.0, -(zz - np.sign(zz) * pen1[at]) / ((beta + np.sqrt(n[:, at])) / alpha + pen2[at]))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            at, v, y = samples[k]
            at, v = np.append(at, width), np.append(v, 1.0)
            w = weights(at)
            p = np.exp((s := w @ v) - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * v
            nn = n[:, at]
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[:, at] += g - sigma * w
            n[:, at] = nn + g * g
    w = weights(np.arange(width + 1))
    return w[:, :width], w[:, width]


def cool(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log-loss on held-back rows."""

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.05, 5, 60), key=loss) if len(y) else 1.0


def train(docs: DataFrame, teaching, max_train_rows: int = 700, bits: int = 15) -> Model | None:
    """The model from the rows of docs for which the condition `teaching` holds; None if they teach nothing."""
    width = 1 << bits
    rows = docs.where(teaching & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, seen = np.zeros(width, np.int64), 0
        for b in batches:
            for t in b["text"]:
                if (c := grams(t, bits)) is not None:
                    df += c > 0
                    seen += 1
        yield pd.DataFrame({"feature": np.arange(-1, width), "df": np.concatenate([[seen], df])})

    df = np.zeros(width + 1)
    for r in rows.select("text").mapInPandas(frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():  # 2^bits rows at any size
        df[r["feature"] + 1] = r["df"]
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, max_train_rows / v))])

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, lang, t in zip(b["doc_id"], b["lang"], b["text"], strict=True):
                if (c := grams(t, bits)) is not None:
                    at = np.flatnonzero(c)
                    v = c[at] * idf[at]
                    out.append((i, lang, at.astype(np.int32).tobytes(), (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "at", "v"])

    sample = rows.where(unit_hash(F.col("doc_id"), F.lit(3)) < share[F.col("lang")]).mapInPandas(sparse, "doc_id long, lang string, at binary, v binary")
    sample = sample.groupBy("doc_id", "lang").agg(F.min(F.struct("at", "v")).alias("x")).select("doc_id", "lang", "x.*").collect()  # a repeated id teaches once
    sample.sort(key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["lang"], bytes(r["at"])))
    labels = sorted({r["lang"] for r in sample})
    if not labels:
        return None
    ready = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32).astype(float), labels.index(r["lang"])) for r in sample]
    w, bias = fit([x for k, x in enumerate(ready) if k % 5], len(labels), width)
    back = ready[::5]
    logits = np.array([w[:, at] @ v + bias for at, v, _ in back]) if back else np.zeros((0, len(labels)))
    return Model(labels, w.astype(np.float32), bias, idf.astype(np.float32), float(cool(logits, np.array([y for *_, y in back], int))))


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2, max_train_rows: int = 700, bits: int = 15) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; the rows of the held fold teach nothing."""
    model = train(docs, crc_fold(F.col("doc_id"), folds) != held_fold, max_train_rows, bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [model.predict(c) if model and (c := grams(t, bits)) is not None else ("und", 0.0) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, "doc_id long, lang_pred string, score double").select("doc_id", (crc_fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "lang_pred", "score")

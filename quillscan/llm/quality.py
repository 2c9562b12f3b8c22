"""Operator 8: quality classifier. Histogram gradient-boosted trees over document statistics, flattened into
arrays that numpy traverses for a whole batch at once.

Statistics are taken from whole texts, in Arrow batches on the executors. The trees are grown on the driver from the
statistics (never the texts) of a bounded sample of labelled rows: `max_train_rows`, drawn by a stable hash of the
row's id. Everything else covers all rows.

Defined results: an empty table gives no rows, and very long texts are read whole; a null text counts as empty and gets a score like any other text. Labels with a null id or a null
quality are not used; an id labelled several times counts with the mean of its labels, rounded half up; repeated
ids of documents teach once. Without any usable label all scores are 0.5; with labels of one class only, that class.
Extra columns of the input are ignored by `score` and kept by `keep_good`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import crc_fold, materialize, unit_hash

FEATURES = (
    "log_chars", "log_words", "word_mean", "word_std", "distinct_share", "top_share", "same_as_last", "pair_distinct",
    "upper_share", "letter_share", "digit_share", "space_share", "symbol_share", "symbol_ended", "bang_share", "pipe_share",
    "line_mean", "line_distinct", "stop_share", "bytes_per_char", "packed_share", "entropy", "capital_words", "long_words", "upper_words",
)
_KIND = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 1 if "a" <= _ch <= "z" or _c >= 128 else 2 if "A" <= _ch <= "Z" else 3 if "0" <= _ch <= "9" else 4 if _ch in " \t\r\n\v\f" else 5 if _ch in ".,;:!?'\"()-" else 6
_SYMBOLS = frozenset(b"#$%&*@^~|<>{}[]\\=+_/!")


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=7)
    words, n_chars = data.split(), len(text)
    m = len(words)
    p = counts[counts > 0] / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    out = [math.log1p(n_chars), math.log1p(m)]
    if m:
        lengths = np.fromiter(map(len, words), np.float64, m)
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        ended = sum(w[-1] in _SYMBOLS for w in words)
        capital = sum(65 <= w[0] <= 90 for w in words)
        out += [lengths.mean(), lengths.std(), len(tally) / m, max(tally.values()) / m, sum(map(bytes.__eq__, words[1:], words)) / m, len(set(zip(words, words[1:], strict=False))) / m]
    else:
        ended = capital = 0
        out += [0.0] * 6
    out += [kinds[2] / n, (kinds[1] + kinds[2]) / n, kinds[3] / n, kinds[4] / n, kinds[6] / n, ended / max(m, 1), counts[33] / n, counts[124] / n]
    out += [n / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), sum(len(w) <= 3 for w in words) / max(m, 1), n / n_chars]
    out += [len(zlib.compress(data, 1)) / n, float(-(p * np.log2(p)).sum()), capital / max(m, 1)]
    out += [float((lengths > 20).mean()) if m else 0.0, sum(w.isupper() for w in words) / max(m, 1)]
    return [float(x) for x in out]


@dataclass
class Forest:
    """Trees as parallel arrays, one node after the other. A leaf is its own child, so `depth` equal steps bring every
    row of a batch to its leaf without a branch."""

    base: float = 0.0
    depth: int = 0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            margin += self.value[at]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss on quantile-binned features, level by level."""
    rows, width = x.shape
    if not rows:
        return Forest()
    mean = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    base = math.log(mean / (1 - mean))
    if y.min() == y.max():
        return Forest(base=base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for part, start in ((feature, 0), (threshold, math.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            part.append(start)
        return len(feature) - 1

    margin = np.full(rows, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        where = np.zeros(rows, np.int64)  # the open node of each row, -1 once settled
        opened = [root]
        for level in range(depth + 1):
            live = where >= 0
            size = len(opened)
            sg = np.bincount(where[live], weights=g[live], minlength=size)
            sh = np.bincount(where[live], weights=h[live], minlength=size)
            for k, at in enumerate(opened):
                value[at] = -rate * sg[k] / (sh[k] + l2)
            if level == depth:
                break
            best = np.full(size, 1e-6)
            pick = [(-1, 0)] * size
            for j in range(width):
                key = where[live] * bins + binned[live, j]
                hg = np.bincount(key, weights=g[live], minlength=size * bins).reshape(size, bins).cumsum(1)
                hh = np.bincount(key, weights=h[live], minlength=size * bins).reshape(size, bins).cumsum(1)
                gain = hg**2 / (hh + l2) + (sg[:, None] - hg) ** 2 / (sh[:, None] - hh + l2) - (sg**2 / (sh + l2))[:, None]
                gain[(hh < least) | (sh[:, None] - hh < least)] = -1
                gain[:, len(cuts[j]) :] = -1
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(size), top] > best):
                    best[k], pick[k] = gain[k, top[k]], (j, int(top[k]))
            nxt, move = [], np.full(size, -1)
            for k, at in enumerate(opened):
                if pick[k][0] >= 0:
                    feature[at], threshold[at], value[at] = pick[k][0], cuts[pick[k][0]][pick[k][1]], 0.0
                    left[at], right[at] = node(), node()
                    move[k] = len(nxt)
                    nxt += [left[at], right[at]]
            if not nxt:
                break
            js, ts = np.array([max(p[0], 0) for p in pick]), np.array([p[1] for p in pick])
            to = np.full(rows, -1)
            w = where[live]
            to[live] = np.where(move[w] >= 0, move[w] + (binned[live, js[w]] > ts[w]), -1)
            where, opened = to, nxt
        tree = Forest(0.0, depth, *(np.array(a, t) for a, t in ((feature, np.int32), (threshold, float), (left, np.int32), (right, np.int32), (value, float))), np.array([root], np.int32))
        at = np.full(rows, root, np.int32)
        for _ in range(depth):
            at = np.where(x[np.arange(rows), tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
        margin += tree.value[at]
    return Forest(base, depth, *(np.array(a, t) for a, t in ((feature, np.int32), (threshold, float), (left, np.int32), (right, np.int32), (value, float))), np.array(roots, np.int32))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "stats": [statistics(t) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, stats array<double>")


def labelled_sample(labels: DataFrame, max_train_rows: int = 12_000, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """(doc_id, quality) of about max_train_rows labelled ids outside the held fold, drawn by a hash of the id."""
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_fold))
        .groupBy("doc_id")
        .agg(F.floor(F.avg("quality") + 0.5).cast("int").alias("quality"))
    )
    return known.where(unit_hash(F.col("doc_id")) < min(1.0, max_train_rows / max(known.count(), 1)))


def train(stats: DataFrame, sample: DataFrame) -> Forest:
    """The forest from the statistics of the sampled ids; the sample is bounded, so it may be broadcast."""
    rows = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("stats").alias("stats")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return Forest()
    return grow(np.array([r["stats"] for r in rows]), np.array([float(r["quality"] > 0) for r in rows]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. One pass over the texts: the statistics are written to
    the shared folder (25 numbers a document), the forest is trained from them and then applied to them."""
    stats = materialize(with_statistics(docs), "quality-stats")
    forest = train(stats, labelled_sample(labels, max_train_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = forest.predict(np.stack(b["stats"].to_list())) if len(b) else np.zeros(0)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": got})

    return stats.mapInPandas(run, "doc_id long, score double").select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train_rows: int = 12_000) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns. Texts are never shuffled: one pass
    takes the statistics to train on, a second one scores each text where it is read."""
    sample = labelled_sample(labels, max_train_rows)
    forest = train(with_statistics(docs.join(F.broadcast(sample), "doc_id", "left_semi")), sample)

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        return pd.Series(forest.predict(np.array([statistics(t) for t in text])) if len(text) else np.zeros(0))

    return docs.where(quality(F.col("text").cast("string")) >= threshold)


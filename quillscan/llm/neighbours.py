"""Operator 3: approximate nearest neighbours by vantage-point trees, one for each shard of the vectors.

Nearness is the largest inner product. A vector x becomes (x, sqrt(M² - |x|²)) with M the largest norm, a query q becomes
(q, 0); then the Euclidean distance falls as the inner product grows, and a metric tree may search for it. Every node
splits its vectors at the median distance to its vantage point and keeps both sides' distance intervals. A query's
distance to a branch is at least its gap to that interval, by the triangle inequality; the largest gap on the way down
bounds a leaf. A leaf is skipped when its bound times `factor` exceeds the distance of the last neighbour found so far:
factor one restores exact search, larger factors prune more. Each query first visits its few most promising leaves,
which gives the distance to prune by, and then all leaves left, a leaf for all its queries at once.

Equal vectors of a shard are one entry of its tree with the smallest ids. The queries are dealt into blocks, and every
shard gets all of them, a lot of `lot_blocks` blocks in each task, which searches one tree; a task's memory is a shard and a lot. Scores come from the
original vectors (doubles where the column holds them) in double precision, summed in the order of the components.

Defined results: an empty table gives no rows; ties go to the smaller id. Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without
an id. Rows equal in id and vector count once; rows of one id with different vectors are queries and candidates of their own. Vectors of different lengths aren't compared. A query with
fewer candidates than k gets them all. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillscan.llm.common import materialize

#: Share of the largest squared norm by which a score of the search may be off; whatever is as near to the last place stays until exact scores decide.
MARGIN = 1e-9
#: Candidates of a block held before they are trimmed by exact score and id.
HELD = 1 << 20


class Tree:
    """A vantage-point tree over distinct vectors, as arrays: one row for each leaf and its way down."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, top: float, copies: int, leaf: int = 64, seed: int = 1, rows: np.ndarray | None = None):
        order = np.lexsort(vectors.T[::-1])
        v = vectors[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]).any(1)
        group = np.cumsum(new) - 1
        self.vectors = v[new]
        by = np.lexsort((ids[order], group))
        rank = np.arange(len(by)) - np.flatnonzero(new)[group[by]]
        keep = by[rank < copies]
        self.ids, self.owner = ids[order][keep], group[keep]
        self.rows = self.ids if rows is None else rows[order][keep]  # what tells a row from all others
        self.first = np.searchsorted(self.owner, np.arange(len(self.vectors) + 1))
        x = self.vectors.astype(np.float64)
        x = np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])
        rng, self.top = np.random.default_rng(seed), top
        points, ways, leaves = [], [], []
        stack = [(np.arange(len(x)), ())]
        while stack:
            at, way = stack.pop()
            if len(at) <= leaf:
                leaves.append(at)
                ways.append(way)
                continue
            tries = rng.choice(at, min(4, len(at)), replace=False)
            d = np.sqrt(np.maximum(((x[at][:, None, :] - x[tries][None]) ** 2).sum(2), 0)) if len(at) <= 4096 else np.stack([np.linalg.norm(x[at] - x[t], axis=1) for t in tries], 1)
            best = int(d.std(0).argmax())
            d = d[:, best]
            part = np.argsort(d, kind="stable")
            half = len(at) // 2
            node = len(points)
            points.append(x[tries[best], :-1])
            for side in (part[:half], part[half:]):
                stack.append((at[side], (*way, (node, d[side].min(), d[side].max()))))
        self.points = np.array(points).reshape(len(points), x.shape[1] - 1)
        self.ways, self.leaves = ways, leaves

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """A lower bound of each query's distance to each leaf."""
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.top - 2 * q @ self.points.T, 0)) if len(self.points) else np.zeros((len(q), 0))
        out = np.zeros((len(q), len(self.leaves)))
        for k, way in enumerate(self.ways):
            for node, low, high in way:
                np.maximum(out[:, k], np.maximum(low - d[:, node], d[:, node] - high), out=out[:, k])
        return np.nan_to_num(out, nan=0.0, posinf=0.0)  # squares of very large components: nothing is known

    def _trim(self, q: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, entry, score): of the entries held, the best for each query by exact score and smallest id."""
        row, entry = (np.concatenate([np.zeros(0, np.int64), *(h[j] for h in held)]) for j in (0, 1))
        score = np.zeros(len(row))
        for j in range(q.shape[1]):  # in the order of the components, whatever the batch
            score += q[row, j] * self.vectors[entry, j].astype(np.float64)
        order = np.lexsort((self.ids[self.first[entry]], -score, row))
        row, entry, score = row[order], entry[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < want
        return row[keep], entry[keep], score[keep]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float, probe: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query position, id, score) of the k best for each query, in order, and the number of leaf visits; `own` are the queries' rows."""
        q, want = q.astype(np.float64), k + 1
        near, margin = np.full((len(q), want), -np.inf), MARGIN * self.top
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0
        bound, square = self.bounds(q), (q * q).sum(1) + self.top
        first = np.argsort(bound, axis=1, kind="stable")[:, :probe]
        probed = np.zeros(bound.shape, bool)
        np.put_along_axis(probed, first, True, axis=1)
        visits = 0
        for second in (False, True):
            for j, members in enumerate(self.leaves):
                if second:
                    reach = np.sqrt(np.maximum(square - 2 * near[:, -1], 0)) + 1e-6 * np.sqrt(self.top)
                    who = np.flatnonzero(~probed[:, j] & ~(bound[:, j] * factor > reach))
                else:
                    who = np.flatnonzero(probed[:, j])
                if not len(who):
                    continue
                visits += len(who)
                s = q[who] @ self.vectors[members].astype(np.float64).T
                near[who] = -np.sort(-np.hstack([near[who], s]), axis=1)[:, :want]
                row, col = np.nonzero(~(s < near[who, -1:] - margin))
                held.append((who[row], members[col]))
                many += len(row)
                if many > HELD:
                    row, entry, _ = self._trim(q, held, want)
                    held, many = [(row, entry)], 0
        row, entry, score = self._trim(q, held, want)
        many = self.first[entry + 1] - self.first[entry]
        at = np.repeat(self.first[entry], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, score, ids = np.repeat(row, many), np.repeat(score, many), self.ids[at]
        other = self.rows[at] != own[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], ids[rank < k], score[rank < k], visits


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 16_384, block_rows: int = 1024, lot_blocks: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row for which is_query (over vec_id) holds."""
    e = F.col("embedding").cast("array<double>")
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind, own = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(own).alias("embedding")).distinct()
    rows = materialize(rows.withColumns({"dim": F.size("embedding"), "own": F.monotonically_increasing_id()}), "vectors")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    shards, blocks, top = -(-seen["n"] // shard_rows) or 1, -(-seen["q"] // block_rows) or 1, (seen["top"] or 0.0) * (1 + 1e-9)
    lots = -(-blocks // lot_blocks)

    def grow(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["vec_id", "own"])
        tree = Tree(np.stack(b["embedding"].to_list()).astype(kind), b["vec_id"].to_numpy(np.int64), top, k + 1, rows=b["own"].to_numpy(np.int64))
        return pd.DataFrame({"dim": b["dim"].iloc[:1], "shard": b["shard"].iloc[:1], "tree": [pickle.dumps(tree)]})

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": b["dim"].iloc[:1], "block": b["block"].iloc[:1], "asks": [pickle.dumps((b["own"].to_numpy(np.int64), b["vec_id"].to_numpy(np.int64), np.stack(b["embedding"].to_list()).astype(kind)))]})

    def search(trees: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"own": [], "query_id": [], "vec_id": [], "score": []}).astype({"own": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})]
        for tree in map(pickle.loads, trees["tree"]):  # one, or none where no vector of this length fell in the shard
            for own_, ids, q in map(pickle.loads, asks["asks"]):
                row, found, score, _ = tree.search(q, own_, k, factor)
                out.append(pd.DataFrame({"own": own_[row], "query_id": ids[row], "vec_id": found, "score": score}))
        return pd.concat(out, ignore_index=True)

    trees = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "own"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(grow, "dim int, shard int, tree binary")
    asks = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", "own", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInPandas(pack, "dim int, block int, asks binary")
    # A stated query set against all rows, in blocks: each block meets each shard once. Blocks, which are small, go to the shards; a tree is
    # copied only once for each lot of blocks.
    asks = materialize(asks, "asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod("block", F.lit(lots)).cast("int").alias("lot"), "asks")
    trees = materialize(trees, "vp-trees").select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "tree")
    found = trees.groupBy("dim", "shard", "lot").cogroup(asks.groupBy("dim", "shard", "lot")).applyInPandas(search, "own long, query_id long, vec_id long, score double")
    best = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(every: int = 20, k: int = 20) -> str:
    """Brute force over all pairs of a query and a candidate, for DuckDB."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, q.e AS own, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND (c.vec_id <> q.vec_id OR c.e <> q.e) AND len(c.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""

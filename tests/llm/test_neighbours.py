import functools

import numpy as np

from quillscan.llm import neighbours
from pyspark.sql import functions as F


def slow(rows, k, every):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            near = sorted((-float((q * x).sum()), j) for j, x in ok if j != i and len(x) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])}
    return out


def rows(n=500, width=12):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, width)) * rng.uniform(0.5, 2, (n, 1))
    v[50:200] = v[50]  # one very common vector
    return [(k, [float(x) for x in np.float32(v[k])]) for k in range(n)]


def close(got, want):
    got = {tuple(r) for r in got}
    return {g[:3] for g in got} == {w[:3] for w in want} and max(abs(a - b) for a, b in zip((g[3] for g in sorted(got)), (w[3] for w in sorted(want)), strict=True)) < 1e-9


def test_factor_one_is_exact(spark):
    data = rows() + [(1000, None), (1001, []), (1002, [0.0] * 12), (1020, [1.0, None] * 6), (1040, [float("nan")] * 12), (1060, [float("inf")] + [1.0] * 11), (None, [1.0] * 12), (1080, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, label int, dim int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=7, factor=1.0, shard_rows=120, block_rows=9).collect()
    assert close(got, slow(data, 7, 20))


def test_equals_duckdb(spark):
    import duckdb

    data = rows() + [(1000, None), (1001, []), (1002, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [float("inf")] + [1.0] * 11), (1080, [1.0, 2.0]), (1080, [1.0, 2.0])]
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", data)
    got = neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, shard_rows=100).collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(neighbours.oracle_sql()).fetchall())


def test_few_candidates_repeated_rows_and_none(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [0.5, 0.5]), (20, [-1.0, 0.2])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got)] == [(0, 1, 1), (0, 2, 3), (0, 3, 20), (20, 1, 1), (20, 2, 3), (20, 3, 0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_of_one_id_with_different_vectors_all_count(spark):
    import duckdb

    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 5.0]), (1, [9.0, 0.0]), (20, [0.0, 1.0]), (20, [2.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=2).collect()))
    assert [(q, v, s) for q, _, v, s in got if q == 0] == [(0, 1, 9.0), (0, 20, 2.0), (0, 1, 1.0), (0, 1, 0.0), (0, 20, 0.0)]
    assert len(got) == 15
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", data)
    assert got == sorted(c.execute(neighbours.oracle_sql()).fetchall())


def test_recall_and_pruning_with_a_larger_factor():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 64))
    v = centres[rng.integers(0, 10, 6000)] + rng.normal(size=(6000, 64)) * 0.8
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    tree = neighbours.Tree(v, np.arange(6000), 1.0 + 1e-6, 21)
    q = v[::20]
    exact = np.argsort(-(q.astype(float) @ v.astype(float).T), axis=1)[:, :21]
    row, ids, _, visits = tree.search(q, np.arange(0, 6000, 20), 20, 2.0)
    hits = sum(len(set(ids[row == r]) & (set(exact[r]) - {20 * r})) for r in range(len(q)))
    assert hits / (20 * len(q)) > 0.9
    *_, every = tree.search(q, np.arange(0, 6000, 20), 20, 1.0)
    assert visits < every


def test_ties_of_many_different_vectors_go_to_smaller_ids(monkeypatch):
    rng = np.random.default_rng(8)
    v = np.unique(rng.choice([-1.0, 1.0], (3000, 16)).astype(np.float32), axis=0)
    ids = rng.permutation(len(v))
    exact = v.astype(float) @ v.astype(float).T
    for held in (1 << 20, 500):
        monkeypatch.setattr(neighbours, "HELD", held, raising=False)
        row, found, _, _ = neighbours.Tree(v, ids, 16.0 * (1 + 1e-9), 21).search(v[:100], ids[:100], 20, 1.0)
        for r in range(100):
            want = [ids[j] for j in np.lexsort((ids, -exact[r])) if j != r][:20]
            assert found[row == r].tolist() == want


def test_doubles_keep_their_precision_and_ties_their_order(spark):
    rng = np.random.default_rng(12)
    base = rng.integers(-1, 2, (240, 6)) + 1e-10 * rng.integers(0, 3, (240, 6))  # equal as floats, not as doubles
    base[5], base[6] = 1e200, -1e200
    rows = [(k, list(map(float, x))) for k, x in enumerate(base)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, shard_rows=64, block_rows=4, lot_blocks=2).collect()
    want = []
    for q in range(0, 240, 20):
        score = lambda c: functools.reduce(lambda t, j: t + rows[q][1][j] * rows[c][1][j], range(6), 0.0)
        order = sorted((c for c, x in rows if c != q and any(x)), key=lambda c: (-score(c), c))[:20]
        want += [(q, r, c, score(c)) for r, c in enumerate(order, 1)] if any(rows[q][1]) else []
    assert sorted(map(tuple, got)) == want

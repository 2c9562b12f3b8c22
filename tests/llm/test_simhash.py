import numpy as np
import pandas as pd
import xxhash

from quillscan.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, f"{fps[k]:016x}", low[find(k)]) for k, (i, _) in enumerate(rows))


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(12)]
    rows = []
    for k in range(160):
        w = base[k % 12].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = "edit" + str(rng.integers(99))
        rows.append((k + 5, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "two words"), (905, " \t\n"), (906, "İ ſ é" * 3), (907, "x y z w v"), (907, "x y z w v"), (3, "long " * 30_000)]
    return rows


def test_matches_brute_force_over_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    want = slow_components(rows)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert sorted(map(tuple, simhash.near_duplicates(docs, shard_rows=7).collect())) == want  # shards cut into pieces


def test_links_near_pairs_of_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for x in rng.integers(-(2**63), 2**63 - 1, 60).tolist():
        fps.add(x)
        for _ in range(5):
            y = x % 2**64
            for b in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                y ^= 1 << b
            fps.add(y - 2**64 if y >= 2**63 else y)
    fps = sorted(fps)
    near = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 4}
    links = {tuple(r) for r in simhash.fingerprint_links(spark.createDataFrame(pd.DataFrame({"fp": fps})), 4).collect()}

    def parts(pairs):
        root = {x: x for x in fps}
        for _ in fps:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(links) == parts(near)


def test_more_blocks_agree_as_the_corpus_grows():
    assert simhash._blocks(4, 10**5) == (5, 1)
    assert simhash._blocks(4, 10**7) == (6, 2)


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c d"), (4, "a b")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0

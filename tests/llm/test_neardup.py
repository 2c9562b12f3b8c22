import numpy as np
import pandas as pd

import corpus_pipeline
from quillscan.llm import neardup, simhash


def slow_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(texts):
    sets = [slow_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(texts))]


def corpus():
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(25):  # an original, and copies with one to six words of 200 changed: similarities from 0.97 down to 0.74
        base = list(rng.choice(words, 200))
        texts.append(" ".join(base))
        for edits in range(1, 7):
            w = list(base)
            for at in rng.choice(200, edits, replace=False):
                w[at] = f"edit{rng.integers(10**6)}"
            texts.append(" ".join(w))
    return [*texts, "a b c", "A  b\nc", "a b d", "a b c d e f", "", " \n", None]


def test_edited_copies_go_and_others_stay(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    want = sorted(set(slow_groups(texts)))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    thin = {r["doc_id"] for r in simhash.near_duplicates(docs).where("doc_id = component_id").collect()}
    assert len(thin) > len(want) + 20  # what 4 of 64 bits leave in


def test_no_rows(spark):
    assert neardup.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def loose_group():
    """Copies of one text of 150 words with 1 to 14 words changed: some pairs are alike, most aren't, and nearly all meet in a shard."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.choice(2000, 150, replace=False)]
    texts = []
    for n in range(240):
        w = list(base)
        for at in rng.choice(150, 1 + n % 14, replace=False):
            w[at] = f"edit{rng.integers(10**6)}"
        texts.append(" ".join(w))
    return texts


def as_groups(found):
    least = {}
    for r in found:
        least[r["root"]] = min(r["doc_id"], least.get(r["root"], r["doc_id"]))
    return [least[r["root"]] for r in sorted(found, key=lambda r: r["doc_id"])]


def test_a_group_of_near_copies_does_not_make_a_row_for_each_pair(spark, monkeypatch):
    texts, pairs, verified = loose_group(), [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda p, *more: pairs.append(p.count()) or verified(p, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_groups(texts)
    assert 20 < len(set(want)) < 200
    assert as_groups(neardup.near_groups(docs).collect()) == want
    assert sum(pairs) < 20 * len(texts)


def test_pieces_of_a_shard_lose_no_link(spark):
    texts = loose_group()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limits in ({"shard_rows": 7}, {"shard_hashes": 1500}):
        assert as_groups(neardup.near_groups(docs, **limits).collect()) == slow_groups(texts)


def test_a_shard_of_unlinked_pages_of_one_template_is_searched_quickly():
    """2,000 sets that share four fifths of a template each, about 0.47 alike: seconds, and no link; one more pair is found among them."""
    import time

    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 600)
    sets = []
    for _ in range(2000):
        s = base.copy()
        s[rng.choice(600, 120, replace=False)] = rng.integers(-(2**63), 2**63 - 1, 120)
        sets.append(np.sort(s))
    sets.append(np.sort(np.append(sets[7][:-30], rng.integers(-(2**63), 2**63 - 1, 30))))
    frame = pd.DataFrame({"key": range(len(sets)), "root": range(len(sets)), "fp": neardup._signed([neardup.simhash(s.view(np.uint64)) for s in sets]), "asks": True, "set": sets})
    began = time.time()
    assert neardup._Piece(frame, 0.8).own_links() == [(7, 2000)]
    assert time.time() - began < 15


def test_a_tree_finds_the_nearest():
    rng = np.random.default_rng(2)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for x in rng.integers(0, 2**63, 12) for _ in range(25)]
    tree, seen = simhash.Tree([]), []
    for x in dict.fromkeys(near):
        for radius in (0, 3, 26, 64):
            want = min(((x ^ y).bit_count() for y in seen), default=65)
            found = tree.nearest(x, radius)
            assert (found is None) == (want > radius) and (found is None or (seen[found] ^ x).bit_count() == want)
        tree.add(x)
        seen.append(x)


def test_links_come_from_the_trees(spark, monkeypatch):
    """Without what the trees find no two texts are linked; without the shards' second look loosely alike ones stay apart."""
    texts = loose_group() + corpus()[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_groups(texts)
    assert as_groups(neardup.near_groups(docs).collect()) == want
    empty = lambda *a: spark.createDataFrame([], "a long, b long")
    with monkeypatch.context() as m:
        m.setattr(neardup, "_tree_links", empty)
        first = as_groups(neardup.near_groups(docs).collect())
        assert len(set(want)) < len(set(first)) < len(set(texts))
        m.setattr(neardup, "_nearest", empty)
        assert len(set(as_groups(neardup.near_groups(docs).collect()))) == len(set(texts))
    monkeypatch.setattr(simhash.Tree, "nearest", lambda *a: None)
    monkeypatch.setattr(simhash.Tree, "near", lambda *a: iter(()))
    frame = pd.DataFrame({"band": [0] * 3, "value": [0] * 3, "at": [0] * 3, "key": [1, 2, 3], "fp": [7, 7, 6]})

    class Held:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    assert sum(map(len, neardup._nearest(Held())(iter([frame])))) == 0

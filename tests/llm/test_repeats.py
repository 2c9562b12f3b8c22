import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillscan.llm import repeats


def slow(rows, width):
    seen = {}
    raw = [(t or "").encode() for _, t in rows]
    for r in raw:
        for k in range(len(r) - width + 1):
            seen[r[k : k + width]] = seen.get(r[k : k + width], 0) + 1
    out = []
    for (i, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i if i is not None else -1, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdeéß日"), rng.integers(1, 8)))
    words = [word() for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    passages = [text(60) for _ in range(4)]
    rows = []
    for k in range(60):
        t = text(int(rng.integers(5, 120)))
        if k % 3 == 0:
            at = int(rng.integers(0, len(t)))
            p = passages[k % 4]
            a = int(rng.integers(0, 80))
            t = t[:at] + p[a : a + int(rng.integers(80, 330))] + t[at:]
        rows.append((k, t))
    base = rows[7][1]
    for k in range(30):  # near copies
        at = int(rng.integers(0, len(base)))
        rows.append((100 + k, base[:at] + word() + base[at + 3 :]))
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1]), (201, None), (202, ""), (203, "a" * 1000), (204, "ab " * 500), (205, "x" * 199), (206, "y" * 200), (207, text(300) + passages[0] + text(5) + passages[0])]
    return rows


@pytest.mark.parametrize("large", [20_000, 3])
def test_equals_brute_force(spark, large):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, key int, s string")
    got = repeats.remove_repeats(docs, rows_per_range=40, large=large).drop("kept").collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *tuple(r)[1:]) for r in got) == slow(rows, 200)


@pytest.mark.parametrize("weak", [False, True])
def test_segments_are_equal_when_their_bytes_are_whatever_the_grams_hashes(monkeypatch, weak):
    """With hashes that can't tell grams apart, segments still agree only when their bytes do, and under each secret."""
    if weak:
        monkeypatch.setattr(repeats, "_BYTE", np.zeros(256, np.uint64))
    texts = [t.encode() for _, t in corpus() if t and len(t.encode()) >= 200]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    kinds = []
    for secret in (b"a", b"b"):
        start, n, _, _, seg = repeats.find_segments(data, ends, 200, secret)
        by_bytes = {}
        for a, k, d in zip(start.tolist(), n.tolist(), seg.tolist(), strict=True):
            assert by_bytes.setdefault(data[a : a + k + 199].tobytes(), d) == d
        assert len(set(by_bytes.values())) == len(by_bytes) > 50
        kinds.append(set(by_bytes.values()))
    assert not kinds[0] & kinds[1]


def test_equals_duckdb():
    import duckdb

    rows = corpus()
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = c.execute(repeats.oracle_sql()).fetchall()
    assert sorted((i if i is not None else -1, *r) for i, *r in got) == slow(rows, 200)


def test_other_width_one_range_and_no_rows(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = repeats.remove_repeats(docs, width=60).drop("kept").collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *tuple(r)[1:]) for r in got) == slow(corpus(), 60)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    texts = [t.encode() for _, t in corpus() if t]
    parts = [(owner[k], place[k], bytes(data[e - s : e])) for data, ends, owner, place in repeats._joined(texts, 200) for k, (e, s) in enumerate(zip(ends, np.diff(ends, prepend=0), strict=True))]
    assert all(texts[o][p : p + len(x)] == x for o, p, x in parts)
    for o, t in enumerate(texts):
        windows = [p + k for q, p, x in parts if q == o for k in range(len(x) - 199)]
        assert sorted(windows) == list(range(len(t) - 199))


def test_very_long_text_repeats_only_what_it_repeats(spark):
    rng = np.random.default_rng(8)
    long = "".join(map(chr, rng.integers(97, 123, 2_300_000)))
    long += long[999_000:1_001_500]
    got = repeats.remove_repeats(spark.createDataFrame([(1, long), (2, long[5000:5100])], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in got) == [(1, 5000, 2), (2, 0, 0)]


@pytest.mark.parametrize("width", [40, 61, 200])
def test_suffix_classes_equal_a_count_of_the_bytes(width):
    rng = np.random.default_rng(width)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 4000, p=[0.999, 0.001])
    data[1000:1400] = data[2000:2400] = rng.integers(0, 256, 400)
    at = rng.permutation(len(data) - width + 1)
    raw = [data[k : k + width].tobytes() for k in at]
    count = {r: raw.count(r) for r in set(raw)}
    assert repeats.suffix_classes(data, at, width).tolist() == [count[r] for r in raw]
    assert len(repeats.suffix_classes(data, at[:0], width)) == 0


def test_many_equal_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_RANGES", 5)
    text = "".join(np.random.default_rng(3).choice(list("abcdefgh "), 2300))
    docs = spark.range(6_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1, text[:250] + "#" + text[300:380]), (2, "z" * 150)], "doc_id long, text string"))
    got = repeats.remove_repeats(docs, keep_bytes=False).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"], r["count"]) for r in got) == [(0, 2300, 1, 6_000), (1, 250, 1, 1), (2, 0, 0, 1)]

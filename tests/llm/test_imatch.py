import hashlib
import random
import re

import xxhash

from quillscan.llm import imatch


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def slow_terms(text):
    return sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\W_]+", text.lower()) if w})


def slow_hashes(text, inside, few=8):
    terms = slow_terms(text)
    band = [h for h in terms if inside(h)]
    terms = band if len(band) >= few else terms
    out = []
    for first, width in imatch.LEVELS:
        for s in range(imatch.SUBSETS):
            seed = 42
            for h in terms:
                if (h % 2**64 >> first) & ((1 << width) - 1) == s:
                    seed = xxhash.xxh64_intdigest((h % 2**64).to_bytes(8, "little"), seed)
            out.append(seed & 0xFFF)
    return out


def slow(rows, low=2, high=0.02):
    cell = lambda h: (h % 2**64 >> 40) & ((1 << imatch.CELLS) - 1)
    rows = [(i, t or "") for i, t in rows]
    df = {}
    for _, t in rows:
        for c in {cell(h) for h in slow_terms(t)}:
            df[c] = df.get(c, 0) + 1
    inside = lambda h: low <= df.get(cell(h), 0) <= max(high * len(rows), low)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))

    def near(a, b):
        if a == b:
            return 1.0
        best = 0.0
        for k in range(len(imatch.LEVELS)):
            pairs = [(x, y) for x, y in zip(a[32 * k : 32 * k + 32], b[32 * k : 32 * k + 32], strict=True) if x != y or x != imatch.EMPTY]
            best = max(best, sum(x == y for x, y in pairs) / max(len(pairs), 4))
        return best

    text = lambda h: "".join(f"{x:03x}" for x in h)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        part = len(t) // 3
        edited = t[: len(t) - part] + after[:part]
        a, b, c = (slow_hashes(x, inside) for x in (t, edited, after))
        out.append((i if i is not None else -1, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), near(a, b), near(a, c)))
    return sorted(out)


def corpus(n=120):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)] + ["Éa", "日本", "𝕏x"]
    rows = [(k * 3 % 1000, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))) for k in range(n)]
    return rows + [(5000, rows[3][1]), (5001, rows[3][1]), (7, None), (8, ""), (10, "!?"), (11, rows[0][1] * 40)]


def test_equals_brute_force(spark):
    rows = corpus() + [(None, "the end of it"), (20, "same row"), (20, "same row")]
    docs = spark.createDataFrame([(i, t, "o", 2) for i, t in rows], "doc_id long, text string, own string, n_chars int")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *tuple(r)[1:]) for r in imatch.fingerprints(docs).collect())
    want = slow(rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-12 and abs(g[6] - w[6]) < 1e-12


def test_edits_stay_near_and_neighbours_do_not(spark):
    docs = spark.createDataFrame([r for r in corpus(200) if r[1] and len(r[1]) > 200], "doc_id long, text string")
    got = imatch.fingerprints(docs).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.95 * len(got)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "only one here")], "doc_id long, text string")
    assert imatch.fingerprints(docs).first()["near_next"] == 1.0
    assert imatch.fingerprints(docs.limit(0)).count() == 0

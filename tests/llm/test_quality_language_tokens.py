import numpy as np
import pytest

from quillscan.llm import language, quality, tokencount


def prose(rng, alphabet, n):
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(n))


def test_forest_in_arrays_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    forest = quality.grow(x, y, trees=30)

    def walk(row):
        margin = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            margin += forest.value[at]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(forest.predict(x), [walk(r) for r in x])
    assert ((forest.predict(x) > 0.5) == y).mean() > 0.97


def test_quality_on_held_out_rows_and_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(k, prose(rng, "abcdefghij", 60) if k % 3 else prose(rng, "abcdefghij", 60).upper().replace(" ", "!! "), "z") for k in range(300)]
    rows += [(None, None, "z"), (1000, "", "z"), (1001, "é" * 50_000, "z"), (5, rows[5][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(None, 1, 0), (7, None, 0), (8, 1, 0), (8, 1, 1)], "doc_id long, quality int, stats int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(held) > 30 and np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if r["predicted"])
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_language_on_held_out_rows_and_edges(spark):
    rng = np.random.default_rng(3)
    kinds = {"aa": "abcdef", "bb": "fghijk", "cc": "kéñöüß"}
    rows = [(k, prose(rng, list(kinds.values())[k % 3], 40), list(kinds)[k % 3], "s", 1.0) for k in range(240)]
    rows += [(900, None, "aa", "s", 1.0), (901, "12 !? \n", "aa", "s", 1.0), (902, "abc", None, "s", 1.0), (None, "fghij", "bb", "s", 1.0), (903, "ab " * 60_000, "aa", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = language.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[900]["score"] == 0
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert len(held) > 30 and np.mean([r["lang_pred"] == list(kinds)[r["doc_id"] % 3] for r in held]) > 0.97
    assert {r["lang_pred"] for r in language.identify(docs.where("lang is null")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_temperature_cools_overconfident_logits():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 500)
    logits = np.eye(3)[np.where(rng.random(500) < 0.3, rng.integers(0, 3, 500), y)] * 20
    assert language.cool(logits, y) > 3


@pytest.mark.parametrize("text", ["a b\nc", "aé日本\n x𝕏\n\n", "\n", "no end", "tab\t\tx\r\n" * 40, "日" * 500])
def test_spans_cover_the_text_and_counts_add_up(text):
    first, last = tokencount.token_spans(text)
    encoding, _ = tokencount.load(tokencount.VOCABULARY)
    pieces = [encoding.decode_single_token_bytes(t) for t in encoding.encode_ordinary(text)]
    at, want = 0, []
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    for p in pieces:
        want.append((owner[at], owner[at + len(p) - 1]))
        at += len(p)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == want
    ends = tokencount.line_bounds(text)
    assert ends.tolist() == [sum(map(len, text.splitlines(keepends=True)[: k + 1])) for k in range(len(ends))] or "\r" in text or "\t" in text
    section = [k for k in range(len(ends)) for _ in range(ends[k] - (ends[k - 1] if k else 0))]
    slow = {"start": [0.0] * len(ends), "end": [0.0] * len(ends), "majority": [0.0] * len(ends), "shared": [0.0] * len(ends)}
    for a, b in want:
        inside = section[a : b + 1]
        slow["start"][inside[0]] += 1
        slow["end"][inside[-1]] += 1
        slow["majority"][max(dict.fromkeys(inside), key=inside.count)] += 1
        for s in inside:
            slow["shared"][s] += 1 / len(inside)
    for rule, counts in slow.items():
        assert np.allclose(tokencount.attribute(first, last, ends, rule), counts)


def test_crossing_tokens_are_those_whose_ends_lie_in_different_sections(spark):
    texts = ["one two\n\n\nthree \n four", "a\n\n\n\nb\t\t\nc", "", "\n \n \n", "日本\n\n語 \n\n\n x" * 30]
    got = {r["doc_id"]: r["n_crossing"] for r in tokencount.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        section, now = [], 0
        for c in text:
            section.append(now)
            now += c == "\n"
        first, last = tokencount.token_spans(text)
        assert got[k] == sum(section[a] != section[b] for a, b in zip(first.tolist(), last.tolist(), strict=True))
    assert sum(got.values()) > 0


def test_token_counts_of_a_table(spark):
    docs = spark.createDataFrame([(1, "one two\nthree"), (2, None), (3, ""), (None, "x"), (1, "one two\nthree"), (4, "word " * 40_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs).collect()}
    assert got[1]["section_tokens"] == [3.0, 1.0] and got[1]["n_tokens"] == 4 and got[2]["n_tokens"] == got[3]["n_sections"] == 0
    assert all(sum(r["section_tokens"]) == r["n_tokens"] for r in got.values())
    assert tokencount.section_rows(tokencount.count_tokens(docs.where("doc_id = 1"))).count() == 4
    assert tokencount.count_tokens(docs.limit(0)).count() == 0


def test_one_split_is_the_best_of_all_features_and_cuts():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(120, 5)).round(1)
        y = (x[:, seed % 5] + rng.normal(size=120) * 0.7 > 0.2).astype(float)
        forest = quality.grow(x, y, trees=1, depth=1, rate=1.0)
        p = y.mean()
        g, h = p - y, np.full(len(y), p * (1 - p))
        whole = g.sum() ** 2 / (h.sum() + 1)
        best = 0.0
        for j in range(5):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
                left = x[:, j] <= cut
                if min(h[left].sum(), h[~left].sum()) >= 2:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
                    best = max(best, gain)
        root = forest.roots[0]
        left = x[:, forest.feature[root]] <= forest.threshold[root]
        gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
        assert gain == pytest.approx(best)
        for side, child in ((left, forest.left[root]), (~left, forest.right[root])):
            assert forest.value[child] == pytest.approx(-g[side].sum() / (h[side].sum() + 1))


@pytest.mark.parametrize("text", ["One two  two\nTHREE!! four, 5 6 é日\n\nOne two two\n", "a", "Ab# " * 9 + "supercalifragilisticexpialidocious"])
def test_statistics_are_what_they_are_called(text):
    import math

    got = quality.statistics(text)
    assert len(got) == len(quality.FEATURES)
    data, words = text.encode(), text.encode().split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    size = [len(w) for w in words]
    mean = sum(size) / len(size)
    want = [
        math.log(1 + len(text)), math.log(1 + len(words)), mean, math.sqrt(sum((s - mean) ** 2 for s in size) / len(size)), len(set(words)) / len(words),
        max(words.count(w) for w in words) / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), len(set(zip(words, words[1:], strict=False))) / len(words),
    ]
    assert got[:8] == pytest.approx(want)
    assert got[8] == pytest.approx(sum(65 <= c <= 90 for c in data) / len(data)) and got[10] == pytest.approx(sum(48 <= c <= 57 for c in data) / len(data))
    assert got[16:20] == pytest.approx([len(data) / len(lines), len(set(lines)) / len(lines), sum(s <= 3 for s in size) / len(words), len(data) / len(text)])
    shares = [data.count(c) / len(data) for c in set(data)]
    assert got[21] == pytest.approx(-sum(p * math.log2(p) for p in shares))


def test_ftrl_equals_a_loop_over_single_weights():
    import math

    rng = np.random.default_rng(8)
    samples = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4), int(rng.integers(0, 3))) for _ in range(40)]
    alpha, beta, l1, l2, width = 0.7, 0.5, 0.05, 0.02, 12
    got_w, got_b = language.fit(samples, 3, width, alpha, beta, l1, l2, epochs=2)
    z = [[0.0] * (width + 1) for _ in range(3)]
    n = [[0.0] * (width + 1) for _ in range(3)]

    def weight(c, i):
        a, b = (l1, l2) if i < width else (0.0, 0.0)
        return 0.0 if abs(z[c][i]) <= a else -(z[c][i] - math.copysign(a, z[c][i])) / ((beta + math.sqrt(n[c][i])) / alpha + b)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(samples)):
            at, v, y = samples[k]
            pairs = [*zip(at.tolist(), v.tolist(), strict=True), (width, 1.0)]
            w = [[weight(c, i) for i, _ in pairs] for c in range(3)]
            e = [math.exp(sum(a * x for a, (_, x) in zip(w[c], pairs, strict=True))) for c in range(3)]
            for c in range(3):
                for j, (i, x) in enumerate(pairs):
                    g = (e[c] / sum(e) - (c == y)) * x
                    z[c][i] += g - (math.sqrt(n[c][i] + g * g) - math.sqrt(n[c][i])) / alpha * w[c][j]
                    n[c][i] += g * g
    assert np.allclose(got_w, [[weight(c, i) for i in range(width)] for c in range(3)]) and np.allclose(got_b, [weight(c, width) for c in range(3)])


def test_grams_are_all_one_to_three_letter_runs():
    for text in ("Über-all 12 x", "日本 語", "aa aa aa"):
        counts = language.grams(text, 15)
        spelled = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        assert counts.sum() == sum(max(len(spelled) - k, 0) for k in range(3))
        assert (counts == language.grams(text.upper(), 15)).all() and (counts > 0).sum() <= len({spelled[i : i + k] for k in (1, 2, 3) for i in range(len(spelled) - k + 1)})
    assert language.grams("12 !?", 15) is None and language.grams(None, 15) is None

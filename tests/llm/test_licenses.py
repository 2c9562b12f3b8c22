"""License scans: base places against SQL, fuzzy matches against a plain edit-distance search, planted and clean texts."""

import random
import re

import numpy as np
import pytest

from quillscan.llm import licenses, queries
from tests.oracle import connect, rows

SHAPE = "doc_id long, text string, label string, score double, start long, base boolean, n_words long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def stands(n, text):
    """Whether any stretch of text (words between single spaces) is within the notice's edits and its words hold the core: all starts at once."""
    if f" {n.core} " not in text:
        return False
    m, codes = len(n.words), np.array([ord(c) for c in text] + [0] * (len(n.words) + n.edits))
    starts = np.arange(len(text))
    d = [np.full(len(text), j) for j in range(m + 1)]
    for k in range(1, m + n.edits + 1):
        c, above = codes[starts + k - 1], d
        d = [np.full(len(text), k)]
        for j, x in enumerate(n.words, 1):
            d.append(np.minimum(np.minimum(above[j], d[j - 1]) + 1, above[j - 1] + (c != ord(x))))
        for s in np.flatnonzero((d[m] <= n.edits) & (starts + k <= len(text))):
            part = text[s : s + k]
            first, last = s + len(part) - len(part.lstrip(" ")), s + len(part.rstrip(" "))
            if n.core and f" {n.core} " in text[text.rfind(" ", 0, first + 1) : text.find(" ", last) + 1]:
                return True
    return False


def brute_labels(text):
    words = WORD.findall(low(text))
    joined = f" {' '.join(words)} "
    found = {label for phrase, label in licenses.BASE if f" {phrase} " in joined}
    found |= {n.label for n in licenses.NOTICES if n.label not in found and stands(n, joined)}
    return ",".join(sorted(found))


def edited(rng, text, k):
    for _ in range(k):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("abcxyz é-") + text[at:], text[:at] + rng.choice("abcxyz") + text[at + 1 :]])
    return text


def test_base_places_equal_duckdb(spark):
    sf = "/root/testdata/sf0.01"
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM w, range(1, len(words) + 1) t(i) WHERE words[i:i + {len(p.split()) - 1}] = {p.split()}" for p, label in licenses.BASE
    )
    sql = f"""WITH w AS (SELECT doc_id, {words} AS words FROM documents), p AS ({places})
        SELECT w.doc_id, len(words) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM w LEFT JOIN p ON p.doc_id = w.doc_id GROUP BY ALL"""
    cursor = connect(sf).execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    df = queries.op13_license_scan(spark, sf).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows(df.columns, df.collect()) == want


def test_fuzzy_labels_equal_an_edit_distance_search(spark):
    rng, texts = random.Random(3), []
    for k in range(220):
        n = rng.choice(licenses.NOTICES)
        parts = [rng.choice(["thing", "mit", "license", "version 3", "cc by", "über", "under the"]) for _ in range(rng.randint(0, 8))]
        parts.insert(rng.randint(0, len(parts)), edited(rng, n.words.title() if k % 2 else n.words, rng.randint(0, n.edits + 1)))
        texts.append(rng.choice([" ", ", ", "\n\t"]).join(parts))
    df = spark.createDataFrame([(k, t, "x", 0.5, 1, True, 7) for k, t in enumerate(texts)], SHAPE)
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    want = {k: brute_labels(t) for k, t in enumerate(texts)}
    assert {k: (texts[k], got[k], w) for k, w in want.items() if got[k] != w} == {}
    assert sum(bool(w) for w in want.values()) > 120


@pytest.mark.parametrize("text", ["", None, "Nothing here", "mit der Lizenz unter dem Apfel", "the license under version 2", "cc by sa 4.0", "under the old license", "under the gpl license"])
def test_clean_texts_have_no_label(spark, text):
    (r,) = licenses.scan(spark.createDataFrame([(2**62 + 1, text, "x", 0.5, 1, True, 7)], SHAPE)).collect()
    assert (r["labels"], r["n_base"], r["first_word"], r["score"], r["doc_id"]) == ("", 0, None, 0.0, 2**62 + 1)


def test_spans_are_those_of_the_whole_text(spark):
    text = "é\U0001f600 -- Relesed  UNDER\nthe MIT Licence; cc-by-nc! " * 3
    got = sorted((r["start"], r["end"], r["label"], r["base"]) for r in licenses.find(spark.createDataFrame([(None, text, "x", 0.5, 1, True, 7), (2**62 + 1, "x", "x", 0.5, 1, True, 7)], SHAPE)).collect())
    assert {text[a:b] for a, b, label, base in got if label == "mit"} >= {"Relesed  UNDER\nthe MIT Licence"}
    assert [text[a:b] for a, b, label, base in got if base] == ["cc-by-nc"] * 3
    assert licenses.find(spark.createDataFrame([], SHAPE)).collect() == [] and licenses.scan(spark.createDataFrame([], SHAPE)).collect() == []


def test_long_texts_and_many_matches_take_linear_time(spark):
    text = "filler words and more " * 50_000 + "licensed under cc by nc 4 0 x " * 20_000
    (r,) = licenses.scan(spark.createDataFrame([(1, text, "x", 0.5, 1, True, 7)], SHAPE)).collect()
    assert (r["n_base"], r["base_labels"], r["labels"], r["score"]) == (20_000, "cc-by-nc", "cc-by-nc", 1.0)

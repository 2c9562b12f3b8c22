import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from quillscan.llm import pieces

PIECES = ["a", "e", "t", "h", "n", " ", " ", "  ", "\n", "é", "日", "本", "𝕏", "▁", "ing", "the", ".", "1", "Ж", "\t", "ation", "        "]


def proto(kind):
    with open(pieces.MODEL, "rb") as f:
        m = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if kind == "unigram":  # the same pieces under scores of their own
        m.trainer_spec.model_type = 1
        rng = random.Random(9)
        for p in m.pieces:
            p.score = -rng.uniform(2, 20)
    return m.SerializeToString()


def weight(model, text, ids):
    return sum(model.score.get(k, 0.0) for k in ids) + model.unknown_score * sum(c not in model.ids for c in model.normalised(text))


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_equals_the_library_for_any_chunk_size(kind):
    model, library = pieces.Model(proto(kind)), sentencepiece.SentencePieceProcessor(model_proto=proto(kind))
    rng = random.Random(kind)
    for _ in range(500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        want = library.encode(text)
        for got in (model.encode(text).tolist(), model.encode(text, rng.randint(1, 40)).tolist()):
            if kind == "bpe":
                assert got == want
            else:  # of equally good segmentations any will do
                assert model.decode(got) == library.decode(want)
                assert abs(weight(model, text, got) - weight(model, text, want)) < 1e-3
        assert model.decode(want) == library.decode(want) == text.replace("▁", " ")


def test_long_words_and_no_space_at_all():
    model, library = pieces.load(pieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    for text in ("a" * 3000, "日本" * 700, "".join(rng.choice("abcdeé") for _ in range(4000)), " " * 500, "x" + " " * 333 + "y"):
        assert model.encode(text, 64).tolist() == library.encode(text)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_no_piece_crosses_a_cut(kind):
    model, rng = pieces.Model(proto(kind)), random.Random(6)
    assert all(len(model.parts.findall(p)) == 1 for p in model.ids)
    joins = {p.lstrip("▁")[k : k + 2] for p in model.ids for k in range(len(p.lstrip("▁")) - 1)}
    signs = [*"aeZ,.;)(-&#|'\\]^▁\n\t ", "é", "ñ", "Ж", "ё", "日", "本", "据数", "الا", "𝕏", "·"]
    library = sentencepiece.SentencePieceProcessor(model_proto=proto(kind))
    for _ in range(500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 50)))
        parts = model.parts.findall(model.normalised(text))
        assert "".join(parts) == model.normalised(text)
        assert not any(x[-1] + y[0] in joins for x, y in zip(parts, parts[1:], strict=False))
        if kind == "bpe":
            assert model.encode(text).tolist() == model.encode(text, 7).tolist() == library.encode(text)


def test_neighbour_rule_equals_merging():
    model, rng = pieces.Model(proto("bpe")), random.Random(2)
    known = list(model.text)
    for k in range(6000):
        a, b = rng.choice(known[:3000] if k % 2 else known), rng.choice(known[:3000] if k % 2 else known)
        assert model._allowed(a, b) == model._tried(a, b)


def test_product_is_associative():
    model, rng = pieces.Model(proto("unigram")), random.Random(3)
    text = model.normalised("".join(rng.choice("abcdefgh") for _ in range(120)))
    parts = pieces.cut(text, 30, model.longest)
    m = [model.transfer(*c, k == 0, k == len(parts) - 1) for k, c in enumerate(parts)]
    left, right = pieces.combine(pieces.combine(m[0], m[1]), m[2]), pieces.combine(m[0], pieces.combine(m[1], m[2]))
    assert left.keys() == right.keys()
    assert all(left[i].keys() == right[i].keys() and all(abs(left[i][j] - right[i][j]) < 1e-6 for j in left[i]) for i in left)


def test_scan_of_groups_equals_that_of_all():
    model, rng = pieces.Model(proto("unigram")), random.Random(8)
    parts = pieces.cut(model.normalised("".join(rng.choice("abcdefgh 日") for _ in range(400))), 20, model.longest)
    m = [model.transfer(*c, k == 0, k == len(parts) - 1) for k, c in enumerate(parts)]
    groups = [m[k : k + 3] for k in range(0, len(m), 3)]
    ends = pieces.scan([pieces.combined(g) for g in groups])
    assert [x for g, e in zip(groups, ends, strict=True) for x in pieces.scan(g, *e)] == pieces.scan(m)


@pytest.mark.parametrize("group", [2, 256])
def test_table_with_giants_and_edges(spark, monkeypatch, group):
    monkeypatch.setattr(pieces, "GROUP", group)
    rng = random.Random(6)
    text = "".join(rng.choice(PIECES) for _ in range(3000))
    rows = [(1, "one two"), (2, None), (3, ""), (None, text), (5, text), (5, text), (6, text[:199]), (7, text[:200]), (8, "z" * 900)]
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in rows], "doc_id long, text string, ids long, key string")
    got = pieces.encode(docs, chunk_chars=200)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = sorted((i or -1, library.encode(t or "")) for i, t in rows)
    found = got.collect()
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in found) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in pieces.decode(got).collect()) == sorted((i or -1, (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.encode(docs.limit(0)).count() == 0

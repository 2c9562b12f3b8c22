import corpus_pipeline
import numpy as np
import sentencepiece

from quillscan.llm import mixing, pieces, quality, secrets, simhash


def test_stages_in_turn(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(200)]
    rows = []
    for k in range(200):
        text = " ".join(rng.choice(words, 60))
        if k % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        if k % 7 == 0:
            text += " password=abcdef1234567890"
        rows.append((k, text, ["en", "de"][k % 2], f"s{k % 3}", len(text)))
    rows += [(300 + k, rows[1][1], "en", "s1", rows[1][4]) for k in range(5)] + [(400, None, None, None, None), (401, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    kept = docs.where(docs["doc_id"].isin(list(good)))
    first = {r["doc_id"] for r in simhash.near_duplicates(kept).where("doc_id = component_id").collect()}
    clean = secrets.redact(docs.where(docs["doc_id"].isin(list(first))))
    want = {r["doc_id"]: r["text"] or "" for r in mixing.sample(clean).collect()}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert got == {i: library.encode(t) for i, t in want.items()}
    assert len([i for i in good if i < 200]) > 150 and not {301, 302, 303, 304} & set(got)
    assert all("password=" not in t for t in want.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns

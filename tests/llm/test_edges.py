"""The same odd tables for every operator on documents: one result row each, never an error."""

import pytest

from quillscan.llm import imatch, language, licenses, merkle, mixing, neardup, pieces, quality, repeats, secrets, simhash, tokencount

SHAPE = (
    "doc_id long, text string, lang string, source string, n_chars long, topic string, key string, rank int, score double, fp long, root long, stats array<double>, "
    "ids array<int>, spans string, n_tokens long, seg long, th long, pos int, quality string, weight double, probability double, component_id long, own string, edited string"
)
EXTRA = ("t", "k", 1, 0.5, 7, 7, [1.0], [1], "s", 3, 4, 5, 6, "q", 0.1, 0.2, 8, "o", "e")
TABLES = {
    "all_null": [(None,) * 24] * 3,
    "null_texts": [(k, None, None, None, None, *EXTRA) for k in range(4)],
    "empty_texts": [(k, "", "en", "s", 0, *EXTRA) for k in range(4)],
    "one_row": [(1, "just one", "en", "s", 8, *EXTRA)],
    "repeated": [(1, "the same words again and again " * 20, "en", "s", 5, *EXTRA)] * 5,
    "odd": [(-5, "\x00�\U0001f600  x", "", "", -1, *EXTRA), (2**62, "\n\n\n", "xx", "y", 3, *EXTRA), (0, "a" * 70_000, "en", "s", 1, *EXTRA), (3, "ÀÉ" * 4000, "fr", "s", 1, *EXTRA)],
    "none": [],
}
OPERATORS = {
    "mixing": lambda d, labels: mixing.weigh(d),
    "secrets": lambda d, labels: secrets.scan(d),
    "repeats": lambda d, labels: repeats.remove_repeats(d),
    "pieces": lambda d, labels: pieces.encode(d, chunk_chars=30_000),
    "imatch": lambda d, labels: imatch.fingerprints(d),
    "language": lambda d, labels: language.identify(d),
    "quality": lambda d, labels: quality.score(d, labels),
    "simhash": lambda d, labels: simhash.near_duplicates(d),
    "tokens": lambda d, labels: tokencount.count_tokens(d),
    "merkle": lambda d, labels: merkle.verified(merkle.manifest(d, changed=merkle.tampered(d))),
    "licenses": lambda d, labels: licenses.scan(d),
}
STAGES = {
    "quality": lambda d, labels: quality.keep_good(d, labels),
    "neardup": lambda d, labels: neardup.drop_near_copies(d),
    "secrets": lambda d, labels: secrets.redact(d),
    "mixing": lambda d, labels: mixing.sample(d),
}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("table", TABLES)
def test_operators(spark, labels, table):
    docs = spark.createDataFrame(TABLES[table], SHAPE)
    for name, run in OPERATORS.items():
        assert len(run(docs, labels).collect()) == len(TABLES[table]), name


@pytest.mark.parametrize("table", TABLES)
def test_stages_keep_the_columns(spark, labels, table):
    docs = spark.createDataFrame(TABLES[table], SHAPE)
    for name, run in STAGES.items():
        out = run(docs, labels)
        assert out.columns == docs.columns and out.count() <= len(TABLES[table]), name

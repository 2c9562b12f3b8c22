import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillscan.llm import mixing


def rows():
    rng = random.Random(2)
    out = []
    for k in range(600):
        source = rng.choice(["hot"] * 5 + ["a", "b", None])
        lang = rng.choice(["en", "en", "de", None if source == "a" else "fr"])
        out.append((k, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 3, 20, 160, 170, 700]))), lang, source, 7))
    return out + [(900, None, "en", "hot", 1), (None, "one two", "en", "a", 1), (5, "again \n\t here", "de", "b", 1), (901, "lone", "xx", "yy", 0), (902, "", "zz", "empty", 0)]


SHAPE = "doc_id long, text string, lang string, source string, weight int"


def test_equals_duckdb(spark):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, weight INT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows())
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = sorted(c.execute(mixing.oracle_sql()).fetchall(), key=key)
    got = sorted(map(tuple, mixing.weigh(spark.createDataFrame(rows(), SHAPE)).collect()), key=key)
    assert len(got) == len(rows()) and got == want


def test_raked_margins_meet_the_targets(spark):
    targets = {"source": {"hot": 0.2, "a": 0.3, "b": 0.5, "absent": 9.0}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"short": 0.4, "medium": 0.4, "long": 0.2}}
    docs = spark.createDataFrame([r for r in rows() if r[2] in ("en", "de") and r[3] in ("hot", "a", "b")], SHAPE)
    keyed, (tokens, *names) = mixing._keyed(docs, None)
    cells = keyed.groupBy(*[keyed[c].alias(m) for c, m in zip(names, mixing.MARGINS, strict=True)]).agg({tokens: "sum", "doc_id": "count"}).toDF(*mixing.MARGINS, "tokens", "docs")
    raked = mixing.rake(cells, targets, rounds=60).toPandas()
    for m in mixing.MARGINS:
        shares = {k: v for k, v in targets[m].items() if k != "absent"}
        for k, v in raked.groupby(m)["weight"].sum().items():
            assert v == pytest.approx(shares[k] / sum(shares.values()), abs=1e-6)
    p = mixing.calibrate(spark.createDataFrame(raked), 0.6).toPandas()
    assert (p["probability"] * p["tokens"]).sum() == pytest.approx(0.6 * p["tokens"].sum(), rel=1e-6)
    assert p["probability"].between(0, 1).all()


def test_sample_keeps_columns_and_follows_the_probabilities(spark):
    docs = spark.createDataFrame(rows(), SHAPE)
    taken = mixing.sample(docs)
    assert taken.columns == docs.columns
    weighed = mixing.weigh(docs).collect()
    assert taken.count() == sum(r["sampled"] or False for r in weighed)
    expected = sum(r["probability"] * r["n_tokens"] for r in weighed)
    assert expected == pytest.approx(0.5 * sum(r["n_tokens"] for r in weighed), rel=1e-4)
    assert abs(sum(r["n_tokens"] for r in weighed if r["sampled"]) / expected - 1) < 0.2
    assert mixing.sample(docs.limit(0)).count() == 0
    odd = docs.withColumns({c: F.lit("x") for c in ("__tokens", "__SOURCE", "__topic", "__p", "__w", "__sampled")})
    assert mixing.sample(odd).select(*docs.columns).exceptAll(taken).count() == 0 and mixing.sample(odd).where("__tokens = 'x' AND __p = 'x'").count() == taken.count()
    assert mixing.weigh(docs, topic="weight").where("topic = '7'").count() == 600


def test_targets_that_cannot_be_met_are_reported(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 0), (2, "a b c", "de", "y", 0)], SHAPE)
    with pytest.warns(UserWarning, match="targets not met after 3 rounds"):
        mixing.weigh(docs, {"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": 1.0}, rounds=3).collect()

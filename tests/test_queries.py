import pytest

from quillscan.plans import queries
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE:
        assert same(df, duck, queries.ORACLE[name]) > 0
    else:
        assert len(df.collect()) > 0


def test_whole_tables_under_the_built_in_rules_equal_a_plain_loop(spark):
    from quillscan.functions import matching
    from quillscan.functions.catalog import builtin_rules
    from quillscan.functions.rewrite import rewrite
    from quillscan.operators.scan import scan_text

    docs = [(str(r["doc_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pages = [(f"page {r['page_id']}", r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    ready, want = matching.prepare(builtin_rules()), set()
    for path, text in docs + pages:
        for x in scan_text(text, path, ready, any_dialect=True) if text is not None else []:
            if (path, x[0], x[5], x[6], False) not in want:
                want.add((path, x[0], x[5], x[6], x[9]))
    assert {tuple(r) for r in queries.q_builtin_scan(spark, SF).collect()} == want
    got = {r["path"]: r["transforms"] for r in queries.q_rewritten_documents(spark, SF).collect()}
    assert {k: bool(v != "[]") for k, v in got.items()} == {p: bool(rewrite(t or "")[1]) for p, t in docs}

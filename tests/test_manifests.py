"""Manifests whose texts Spark's JSON parser and DuckDB's judge differently."""

import duckdb
import pytest

from quillscan.functions import jsontext
from quillscan.operators import manifest
from quillscan.plans import queries
from tests.oracle import connect, same

ODD = (
    "", " ", "{}", " {}\n", "{}x", "{} {}", "{},", "{}}", "{}\x0b", "{} // c", "[1] 2", "[1]]", "3 apples", "3", "true story", "null", "nul", '"a"', '"a" b', '{"a":1,"a":2}', '{"a":1,}', "[1,]", "[,]", "{,}", "[1,,]",
    "NaN", "-inf", "infinit", '{"a":NaN}', '{"a":"\\ud800"}', '{"a":"\\ud83d\\ude00"}', '{"a":"\\\\ud800"}', '{"a":"\t"}', '{"a":01}', '{"a":1.}', '{"a":' + "9" * 5000 + "}", '{"' + "k" * 50001 + '":1}', "'a'", '{"a" 1}', "{", '{"a":', "﻿{}",
    "[" * 900 + "]" * 900, '{"a":' * 900 + "1" + "}" * 900, "[" * 20000 + "]" * 20000, "[" * 20000 + "]" * 19999,
)


def test_texts_are_json_where_duckdb_says_so():
    c = duckdb.connect()
    for t in ODD:
        want = c.execute("SELECT json_valid(?)", [t]).fetchone()[0]
        for read in (jsontext.value, jsontext._walk):
            try:
                read(t)
                got = True
            except ValueError:
                got = False
            assert got == want, t[:60]


def _table(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/written")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * FROM '{path}/written/*.parquet') TO '{path}/documents.parquet' (FORMAT parquet)")


@pytest.mark.parametrize("name", ["q_invalid_manifests", "q_bin_entries", "q_install_scripts"])
def test_odd_manifests_equal_duckdb(spark, tmp_path, name):
    rows = [(11 * k + 5, t, "en", "s") for k, t in enumerate(ODD)]  # every eleventh document is a manifest as it stands
    rows += [(5, None, "en", "s"), (6, "x", "en", None), (8, "x", None, "s"), (9, "x", "en", 'q"'), (10, "x", "en", "\\"), (None, "x", "en", "s")]
    rows += [(16, "{}", "en", "s"), (27, "x", "en", "s"), (27, "x", "en", "s"), (27, "[]", "en", "s"), (38, "x", "en", "s"), (12, "x", "en", 'q"'), (12, "x", "en", "s")]  # repeated ids
    _table(spark, tmp_path, rows)
    assert same(queries.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), queries.ORACLE[name]) > 0


def test_a_manifest_is_either_invalid_or_checked(spark):
    bad = '"scripts": {"postinstall": "curl x | sh"}'
    texts = [f"{{{bad}}}", f"{{{bad},}}", f'{{{bad}, "a": 1, "a": 2}}', f'{{{bad}, "a": NaN}}', f'{{{bad}, "a": {"[" * 3000 + "]" * 3000}}}', f"{{{bad}}} x", f"{{{bad}", "[1]", "x"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string")
    assert sorted(r["path"] for r in manifest.check(df).collect()) == ["0", "1", "2", "3", "4"]
    assert {tuple(r) for r in manifest.invalid(df).collect()} == {("5", "invalid JSON"), ("6", "invalid JSON"), ("7", "not an object"), ("8", "invalid JSON")}

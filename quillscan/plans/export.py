"""Reports of any size: the entries are rendered by the tasks that hold them, in order, and their parts are joined by a stream of bytes. The driver
holds what a catalog bounds (the rules seen, the score's parts), never the findings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import scan
from quillscan.plans import report
from quillscan.plans.report import Outcome
from quillscan.sources.tables import scratch

_MARK = "@entries@"


def _joined(spark, parts: str, target: str, head: str, tail: str, less: int) -> None:
    """head, the parts' bytes without the last `less` of them, and tail, as one file."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    source, goal = path(parts), path(target if "://" in target else f"file://{target}")
    fs, to = source.getFileSystem(hadoop), goal.getFileSystem(hadoop)
    found = sorted((s.getPath().getName(), s.getLen(), s.getPath()) for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    left = max(sum(n for _, n, _ in found) - less, 0)
    out = to.create(goal, True)
    try:
        out.write(bytearray(head.encode()))
        for _, n, p in found:
            take = min(n, left)
            if take:
                stream = fs.open(p)
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, take)
                finally:
                    stream.close()
                left -= take
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    fs.delete(source, True)


def _write(findings: DataFrame, render: Callable[[dict], dict], body: dict, path: str, indent: int, sort_keys: bool) -> None:
    """The body as JSON, in which the mark stands for the list of all rendered findings."""
    spark = findings.sparkSession
    head, _, tail = json.dumps(body, indent=2, ensure_ascii=False, sort_keys=sort_keys).partition(f'"{_MARK}"')
    pad = ",\n" + " " * indent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [json.dumps(render(json.loads(x)), indent=2, ensure_ascii=False, sort_keys=sort_keys).replace("\n", "\n" + " " * indent) for x in b["f"]]
            yield pd.DataFrame({"value": texts})

    parts = f"{scratch(spark)}/parts"
    scan.ordered(findings).select(F.to_json(F.struct(*report._FIELDS), {"ignoreNullFields": "false"}).alias("f")).mapInPandas(run, "value string").write.option("lineSep", pad).text(parts)
    _joined(spark, parts, path, head, tail, len(pad))


def _facts(scored: DataFrame) -> Outcome:
    s = scored.first()
    return Outcome("", [], s["score"], s["level"], s["verdict"], list(s["tags"]), [c.asDict() for c in s["categories"]]) if s else Outcome("", [])


def write_json(findings: DataFrame, scored: DataFrame, path: str) -> None:
    """report.json_report's bytes as a file on any Hadoop file system; scored holds one row, or none without findings."""
    o = _facts(scored)
    body = json.loads(report.json_report(o))
    if scored.isEmpty():
        _write(findings, lambda f: f, body, path, 0, True)
    else:
        _write(findings, lambda f: f, body | {"findings": [_MARK]}, path, 4, True)


def write_sarif(findings: DataFrame, scored: DataFrame, path: str, base: str | None = None) -> None:
    """report.sarif_report's bytes. A rule's place is that of its first finding in order: an aggregate of one row a rule."""
    first = F.min(F.struct((-F.col("severity_rank")).alias("s"), "file", "deobfuscated", "rule_ordinal", "match_ordinal", F.struct(*scan.COLUMNS).alias("f")))
    seen = [r["f"]["f"].asDict() for r in findings.groupBy("rule_id").agg(first.alias("f")).orderBy("f").collect()]
    body = json.loads(report.sarif_report(_facts(scored).__class__(**{**_facts(scored).__dict__, "findings": seen}), base=base))
    index = {f["rule_id"]: k for k, f in enumerate(seen)}

    def render(f: dict) -> dict:
        made = json.loads(report.sarif_report(Outcome("", [f]), base=base))["runs"][0]["results"][0]
        return made | {"ruleIndex": index[f["rule_id"]]}

    if seen:
        body["runs"][0]["results"] = [_MARK]
    _write(findings, render, body, path, 8, False)


def write_accepted(findings: DataFrame, path: str) -> None:
    """report.write_accepted's bytes: the sorted distinct identities, and how many findings they stand for."""
    spark, parts = findings.sparkSession, f"{scratch(findings.sparkSession)}/parts"
    scan.accepted_keys(findings).select(F.col("key").alias("value")).write.option("lineSep", "\n").text(parts)
    _joined(spark, parts, path, report.accepted_head(findings.count()), "", 0)

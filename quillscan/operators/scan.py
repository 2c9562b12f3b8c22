"""Scanning tables of sources: every rule on the raw and on the rewritten text of each file, in one Arrow pass that is
local to a row. Findings only shuffle afterwards, and they are few."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscan.functions import matching
from quillscan.functions.catalog import Rule, builtin_rules, severity_rank
from quillscan.functions.pretty import pretty
from quillscan.functions.rewrite import rewrite, run_pass
from quillscan.sources.tables import slices

FINDINGS = (
    "rule_id string, rule_name string, description string, severity string, file string, line int, column int, snippet string, "
    "tags array<string>, deobfuscated boolean, severity_rank int, rule_ordinal int, match_ordinal int"
)
COLUMNS = ["rule_id", "rule_name", "description", "severity", "file", "line", "column", "snippet", "tags", "deobfuscated", "severity_rank", "rule_ordinal", "match_ordinal"]


def _without_nulls(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[pd.DataFrame]:
    """The rows without nulls, left out here since a condition in the plan is tried as early as can be: a text that is made of others would be made for that
    once more, and before repeated rows go."""
    for b in batches:
        yield b.dropna(subset=list(columns))


def scan_text(content: str, path: str, ready: list[matching.Ready], deobfuscate: bool = True, any_dialect: bool = False) -> list[tuple]:
    """The findings of one text, as rows of FINDINGS; raw ones first."""
    if not any_dialect and matching.dialect(path) is None:
        return []
    out: list[tuple] = []

    def add(text: str, changed: bool) -> None:
        hidden = matching.suppressed(text)
        for h in matching.hits(text, ready):
            if h.line not in hidden:
                r = ready[h.rule].rule
                out.append((r.id, r.name, r.description, r.severity, path, h.line, h.column, h.snippet, list(r.tags), changed, r.rank, h.rule, len(out)))

    add(content, False)
    if deobfuscate:
        new, record = rewrite(content)
        if any(n for _, n in record):
            add(new, True)
    return out


def scan(sources: DataFrame, rules: list[Rule] | None = None, deobfuscate: bool = True, any_dialect: bool = False) -> DataFrame:
    """Findings of sources(path, content). Rows with a null path or text have none; files of no known dialect have none
    unless any_dialect. Not filtered, deduplicated or sorted."""
    catalog = builtin_rules() if rules is None else rules
    matching.prepare(catalog)  # errors surface here, not in a task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = matching.prepare(catalog)
        for b in slices(_without_nulls(batches, "path", "content"), "content"):
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) for r in scan_text(c, p, ready, deobfuscate, any_dialect)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return sources.select("path", "content").mapInPandas(run, FINDINGS)


def rewritten(sources: DataFrame) -> DataFrame:
    """path, content after rewriting and the transforms applied, for every row of sources(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, "content"):
            done = [rewrite(c or "") for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "content": [t for t, _ in done], "transforms": [[{"pass": p, "changes": n} for p, n in record] for _, record in done]})

    return sources.select("path", "content").mapInPandas(run, "path string, content string, transforms array<struct<pass: string, changes: int>>")


def one_pass(sources: DataFrame) -> DataFrame:
    """path, pass, content and changes of one rewriting pass, or of the layout (`pretty`), over sources(path, pass, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(_without_nulls(batches, "content"), "content"):
            done = [(pretty(c), 1) if p == "pretty" else run_pass(p, c) for p, c in zip(b["pass"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "pass": b["pass"], "content": [t for t, _ in done], "changes": [n for _, n in done]})

    return sources.select("path", "pass", "content").mapInPandas(run, "path string, pass string, content string, changes long")


def transform_totals(versions: DataFrame) -> DataFrame:
    """Changes of each pass over all files."""
    return versions.select(F.explode("transforms").alias("t")).groupBy(F.col("t.pass").alias("pass")).agg(F.sum("t.changes").alias("changes"))


def key() -> F.Column:
    """A finding's identity."""
    return F.concat_ws(":", "rule_id", "file", F.col("line").cast("string"), F.col("column").cast("string"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity_rank") >= severity_rank(severity))


def without_rules(findings: DataFrame, disabled: list[str]) -> DataFrame:
    return findings.where(~F.col("rule_id").isin(disabled)) if disabled else findings


def deduplicate(findings: DataFrame) -> DataFrame:
    """The first of each identity: raw before rewritten, then in order of emission."""
    order = Window.partitionBy("rule_id", "file", "line", "column").orderBy("deobfuscated", "rule_ordinal", "match_ordinal")
    return findings.withColumn("__first", F.row_number().over(order)).where("__first = 1").drop("__first")


def ordered(findings: DataFrame) -> DataFrame:
    """The most severe first; ties by file and emission."""
    return findings.orderBy(F.desc("severity_rank"), "file", "deobfuscated", "rule_ordinal", "match_ordinal")


def except_accepted(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings whose identity isn't in accepted(key)."""
    return findings.withColumn("__key", key()).join(accepted.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def accepted_keys(findings: DataFrame) -> DataFrame:
    """The sorted distinct identities."""
    return findings.select(key().alias("key")).distinct().orderBy("key")


def except_suppressed(findings: DataFrame, sources: DataFrame, next_line: str = matching.SUPPRESS_NEXT, same_line: str = matching.SUPPRESS_LINE) -> DataFrame:
    """Line suppression as a join, for findings made by native expressions: drops those on exempted lines."""
    lines = sources.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("k", "text"))
    hidden = lines.where(F.col("text").contains(next_line) | F.col("text").contains(same_line))
    hidden = hidden.select("file", (F.col("k") + F.when(F.col("text").contains(next_line), 2).otherwise(1)).alias("line"))
    return findings.join(hidden, ["file", "line"], "left_anti")

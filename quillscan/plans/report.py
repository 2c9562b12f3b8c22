"""Reports of a finished scan: text, JSON and SARIF. They work on collected, already reduced results."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSION = "0.1.0"
WORDS = {
    "CLEAN": "PASS — no issues detected",
    "LOW": "PASS — informational findings only",
    "MEDIUM": "REVIEW — suspicious patterns detected",
    "HIGH": "INVESTIGATE — high-risk patterns found",
    "CRITICAL": "BLOCK — likely malicious, do not use",
}
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
_FIELDS = ("rule_id", "rule_name", "description", "severity", "file", "line", "column", "snippet", "tags", "deobfuscated")
_SHORT = {"critical": "[CRIT]", "high": "[HIGH]", "medium": "[MED]", "low": "[LOW]"}


@dataclass(frozen=True)
class Outcome:
    """A subject's findings (dicts, in order) and its row of operators.score.scores."""

    subject: str
    findings: Sequence[dict]
    score: int = 0
    level: str = "CLEAN"
    verdict: str = "PASS"
    tags: Sequence[str] = ()
    categories: Sequence[dict] = field(default=())


def finding_lines(findings: DataFrame) -> DataFrame:
    """value: the JSON object of each finding, for a distributed text or Kafka sink when there are too many to collect."""
    return findings.select(F.to_json(F.struct(*_FIELDS)).alias("value"))


def outcome(subject: str, findings: DataFrame, scored: DataFrame) -> Outcome:
    """Collects one subject's result; scored holds one row, or none when there are no findings."""
    rows = [r.asDict(recursive=True) for r in findings.collect()]
    s = scored.first()
    return Outcome(subject, rows, s["score"], s["level"], s["verdict"], list(s["tags"]), [c.asDict() for c in s["categories"]]) if s else Outcome(subject, rows)


def plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def size_text(n: int) -> str:
    return f"{n / 1048576:.1f} MB" if n >= 1048576 else f"{n / 1024:.1f} KB" if n >= 1024 else f"{n} B"


def time_text(s: float) -> str:
    return f"{s:.2f}s" if s >= 1 else f"{int(s * 1000)}ms"


def text_report(o: Outcome, js_files: int = 0, manifest_files: int = 0, n_bytes: int = 0, seconds: float = 0.0, verbose: bool = False) -> str:
    out = [""]
    if not o.findings:
        out.append(" [OK] no findings")
    places = [f"{f['file']}:{f['line']}" for f in o.findings]
    rule_width, place_width = max((len(f["rule_id"]) for f in o.findings), default=0), min(max(map(len, places), default=0), 56)
    for f, place in zip(o.findings, places, strict=True):
        out.append(f" {_SHORT[f['severity']]:<6} {f['rule_id']:<{rule_width}}  {place:<{place_width}}  {f['rule_name']}{' [deob]' * f['deobfuscated']}")
        if verbose:
            out.append(f"        {f['description']}")
            first = (f["snippet"].splitlines() or [""])[0].strip()
            out += [f"        {first[:96]}"] * bool(first) + [f"        tags: {', '.join(f['tags'])}"] * bool(f["tags"])
    count = {s: sum(f["severity"] == s for f in o.findings) for s in _SHORT}
    label = lambda s: f" {s:<10}"
    out += ["", " " + "─" * 60]
    out.append(f"{label('findings')} {len(o.findings)} total   {count['critical']} crit · {count['high']} high · {count['medium']} med · {count['low']} low")
    out.append(f"{label('scanned')} {plural(js_files, 'file')} · {plural(manifest_files, 'manifest')} · {size_text(n_bytes)} · {time_text(seconds)}")
    out.append(f"{label('score')} {o.score}/100 {o.level}")
    if o.categories:
        out.append(f"{label('breakdown')} {' · '.join(f'{c["category"]} {c["points"]}' for c in o.categories)}")
    if o.tags:
        out.append(f"{label('tags')} {' '.join(o.tags)}")
    out += [f"{label('verdict')} {WORDS['CRITICAL' if o.verdict == 'BLOCK' else o.level]}", " " + "─" * 60]
    return "\n".join(out)


def json_report(o: Outcome) -> str:
    body = {"score": o.score, "risk_level": o.level.lower(), "verdict": o.verdict, "tags": list(o.tags), "categories": [dict(c) for c in o.categories], "findings": [{k: f[k] for k in _FIELDS} for f in o.findings]}
    return json.dumps(body, indent=2, ensure_ascii=False, sort_keys=True)


def relative_uri(path: str, base: str | None = None) -> str:
    base = (base or os.getcwd()).rstrip("/") + "/"
    return path.removeprefix(base).replace("\\", "/")


def rule_index(findings: DataFrame) -> DataFrame:
    """rule_id and the position of its first appearance among the ordered findings(position, rule_id)."""
    first = findings.groupBy("rule_id").agg(F.min("position").alias("first"))
    return first.select("rule_id", (F.row_number().over(Window.orderBy("first")) - 1).alias("rule_index"))


def sarif_report(o: Outcome, tool: str = "quillscan", version: str = VERSION, base: str | None = None) -> str:
    index: dict[str, int] = {}
    rules, results = [], []
    for f in o.findings:
        if f["rule_id"] not in index:
            index[f["rule_id"]] = len(rules)
            rules.append({"id": f["rule_id"], "name": f["rule_name"], "shortDescription": {"text": f["rule_name"]}, "fullDescription": {"text": f["description"]}, "defaultConfiguration": {"level": LEVELS[f["severity"]]}, "properties": {"tags": f["tags"]}})
        place = {"artifactLocation": {"uri": relative_uri(f["file"], base), "uriBaseId": "%SRCROOT%"}, "region": {"startLine": f["line"], "startColumn": f["column"]}}
        results.append({"ruleId": f["rule_id"], "ruleIndex": index[f["rule_id"]], "level": LEVELS[f["severity"]], "message": {"text": f["description"]}, "locations": [{"physicalLocation": place}], "properties": {"deobfuscated": f["deobfuscated"]}})
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": results, "properties": {"riskScore": o.score, "riskLevel": o.level.lower(), "tags": list(o.tags)}}
    return json.dumps({"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def exit_code(findings: Sequence[dict], threshold: str = "high") -> int:
    """2 when a finding is at or over the threshold (unknown ones mean high), else 0."""
    ranks = {"low": 1, "medium": 2, "high": 3, "critical": 4}
    return 2 if any(ranks[f["severity"]] >= ranks.get(threshold.lower(), 3) for f in findings) else 0


def accepted_head(n_findings: int) -> str:
    return f"# accepted findings, one identity a line\n# {n_findings} findings\n"


def write_accepted(keys: list[str], path: str, n_findings: int) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(accepted_head(n_findings) + "".join(f"{k}\n" for k in sorted(set(keys))))


def rule_listing(rules) -> str:
    return "\n".join([*(f"{r.id:<10} {r.severity:<8} {r.name}" for r in rules), f"{len(rules)} rules"])

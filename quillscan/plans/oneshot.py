"""The one-shot scan of a tree: sources, findings, filters, accepted findings and score as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions.catalog import Rule
from quillscan.functions.packages import POPULAR
from quillscan.functions.pretty import pretty
from quillscan.operators import manifest, scan, score
from quillscan.sources import files
from quillscan.sources.tables import stored


@dataclass(frozen=True)
class Options:
    paths: tuple[str, ...] = (".",)
    severity: str = "low"
    disabled: tuple[str, ...] = ()
    code: bool = True
    manifests: bool = True
    deobfuscate: bool = True
    max_bytes: int = files.MAX_BYTES
    popular: tuple[str, ...] = POPULAR


def findings(sources: DataFrame, options: Options, rules: list[Rule] | None = None) -> DataFrame:
    """Ordered, deduplicated findings of sources.files."""
    kept = None if rules is None else [r for r in rules if r.id not in options.disabled]
    parts = []
    if options.code:
        parts.append(scan.scan(sources.where("kind = 'code'"), kept, options.deobfuscate))
    if options.manifests or not options.code:
        parts.append(manifest.as_findings(manifest.check(sources.where("kind = 'manifest'"), options.popular)))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return scan.ordered(scan.deduplicate(scan.without_rules(scan.at_least(found, options.severity), list(options.disabled))))


@dataclass(frozen=True)
class Result:
    findings: DataFrame
    scored: DataFrame
    stats: DataFrame
    suppressed: DataFrame


def run(spark: SparkSession, options: Options, rules: list[Rule] | None = None, accepted: DataFrame | None = None) -> Result:
    sources = files.files(spark, list(options.paths), max_bytes=options.max_bytes)
    every = scan.ordered(stored(findings(sources, options, rules)))  # matched once, whatever is asked of the result
    kept = scan.ordered(scan.except_accepted(every, accepted)) if accepted is not None else every
    hidden = every.count() - kept.count() if accepted is not None else 0
    scored = score.scores(kept.withColumn("subject", F.lit(", ".join(options.paths))), subject="subject")
    return Result(kept, scored, files.scan_stats(sources), spark.range(1).select(F.lit(hidden).alias("suppressed")))


def clean_sources(sources: DataFrame) -> DataFrame:
    """path, content: rewritten and laid out, of the code files."""
    done = scan.rewritten(sources.where("kind = 'code' AND content IS NOT NULL"))

    @F.pandas_udf("string")
    def laid_out(text):
        return text.map(pretty)

    return done.select("path", laid_out("content").alias("content"), "transforms")

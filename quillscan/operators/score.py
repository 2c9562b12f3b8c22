"""Scores, levels, categories, tags and verdicts of subjects, as aggregates over findings. Rules count once for each
subject, whatever the number of their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.functions.catalog import CATEGORIES, POINTS


def points(severity: Column) -> Column:
    out = F.lit(0)
    for name, n in POINTS.items():
        out = F.when(severity == name, n).otherwise(out)
    return out


def level(score: Column) -> Column:
    return F.when(score == 0, "CLEAN").when(score <= 15, "LOW").when(score <= 40, "MEDIUM").when(score <= 70, "HIGH").otherwise("CRITICAL")


def verdict(level_: Column, malware: Column) -> Column:
    return F.when(malware, "BLOCK").when(level_.isin("CLEAN", "LOW"), "PASS").when(level_ == "MEDIUM", "REVIEW").when(level_ == "HIGH", "INVESTIGATE").otherwise("BLOCK")


def category(tags: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    first = F.get(F.filter(F.transform(tags, lambda t: F.try_element_at(known, t)), lambda c: c.isNotNull()), F.lit(0))
    return F.coalesce(first, F.lit("Other"))


def counted(findings: DataFrame, subject: str = "file") -> DataFrame:
    """The first finding of each rule of a subject, with its points and category."""
    order = Window.partitionBy(subject, "rule_id").orderBy(F.desc("severity_rank"), "file", "deobfuscated", "match_ordinal")
    first = findings.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    return first.withColumn("points", points(F.col("severity"))).withColumn("category", category(F.col("tags")))


def categories(findings: DataFrame, subject: str = "file") -> DataFrame:
    """findings and points of each (subject, category), over the counted rules."""
    return counted(findings, subject).groupBy(subject, "category").agg(F.count(F.lit(1)).cast("int").alias("findings"), F.sum("points").cast("int").alias("points"))


def severity_counts(findings: DataFrame, subject: str = "file") -> DataFrame:
    names = ("critical", "high", "medium", "low")
    return findings.groupBy(subject).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in names], F.max("severity_rank").alias("max_rank"))


def scores(findings: DataFrame, subjects: DataFrame | None = None, subject: str = "file") -> DataFrame:
    """subject, score, level, verdict, tags, categories, n_findings; subjects without findings are CLEAN."""
    of = lambda *tags: F.max(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    seen = findings.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.max(F.col("severity") == "critical").alias("critical"),
        of("obfuscation", "encoding").alias("obfuscated"),
        of("exfiltration", "c2").alias("exfiltration"),
        of("execution").alias("execution"),
        of("network").alias("network"),
        of("manifest").alias("manifest"),
        of("recon").alias("recon"),
    )
    parts = categories(findings, subject).groupBy(subject).agg(
        F.sum("points").cast("int").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("o"), "category", "findings", "points"))).alias("parts")
    )
    out = seen.join(parts, subject)
    if subjects is not None:
        out = subjects.select(subject).distinct().join(out, subject, "left")
    score = F.least(F.coalesce("total", F.lit(0)), F.lit(100))
    out = out.withColumn("score", score).withColumn("level", level(F.col("score")))
    malware = (F.col("score") >= 71) | F.coalesce("critical", F.lit(False))
    flags = [(malware, "#malware"), *((F.col(c), t) for c, t in (("obfuscated", "#obfuscated"), ("exfiltration", "#exfiltration"), ("execution", "#execution"), ("network", "#network"), ("manifest", "#manifest"), ("recon", "#recon")))]
    flags.append(((F.col("score") > 0) & (F.col("score") < 71) & ~malware, "#suspicious"))
    return out.select(
        subject, "score", "level", verdict(F.col("level"), malware).alias("verdict"),
        F.array_compact(F.array(*[F.when(c, t) for c, t in flags])).alias("tags"),
        F.coalesce(F.transform("parts", lambda p: F.struct(p["category"].alias("category"), p["findings"].alias("findings"), p["points"].alias("points"))), F.array().cast("array<struct<category:string,findings:int,points:int>>")).alias("categories"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
    )


def flagged_by_label(scored: DataFrame, labels: DataFrame, subject: str = "file", label: str = "label") -> DataFrame:
    """Subjects, flagged ones (BLOCK or INVESTIGATE) and their share for each label: recall and 1 - specificity."""
    flag = F.col("verdict").isin("BLOCK", "INVESTIGATE")
    return scored.join(labels, subject).groupBy(label).agg(F.count(F.lit(1)).alias("subjects"), F.count_if(flag).alias("flagged"), F.avg(flag.cast("int")).alias("share"))


def package_precision(scored: DataFrame) -> DataFrame:
    """clean, flagged and precision = clean / (clean + flagged) over a table of good packages; null verdicts are errors."""
    flag = F.col("verdict").isin("BLOCK", "INVESTIGATE")
    out = scored.agg(F.count_if(F.col("verdict").isNotNull() & ~flag).alias("clean"), F.count_if(flag).alias("flagged"), F.count_if(F.col("verdict").isNull()).alias("errors"))
    return out.withColumn("precision", F.col("clean") / F.nullif(F.col("clean") + F.col("flagged"), F.lit(0)))

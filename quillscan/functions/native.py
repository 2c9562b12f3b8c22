"""Matching with built-in expressions alone: for small rule sets and queries that should stay inside the engine. The same
findings as functions.matching for patterns that both dialects read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions.catalog import NEAR, to_java
from quillscan.functions.matching import SNIPPET


def folded(steps: Column, step: Callable[[Column, Column], Column], length: Callable[[Column], Column], none: Column) -> Column:
    """What `step` collects over an array, from struct(at, out) on, with `length` added to `at` by each entry: `aggregate` copies what it
    has collected at every entry, so the array is folded in blocks of about the square root of its size, each from its own start."""
    size = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(steps) / size).cast("int") - 1, F.lit(0))), lambda b: F.slice(steps, b * size + 1, size))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    advance = lambda a, b: F.struct((a["at"] + F.aggregate(b, F.lit(0), lambda n, x: n + length(x))).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    starts = F.aggregate(blocks, begin, advance, lambda a: a["out"])
    return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))


def matches(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """rows with a row for each match: ordinal, matched, offset (code points from 0). The offset is the length of
    everything before: gaps and earlier matches."""
    java = to_java(pattern)
    found, gaps = F.regexp_extract_all(F.col(text), F.lit(java), F.lit(0)), F.split(F.col(text), java, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    none = F.array().cast("array<struct<matched:string,offset:int>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["g"]
        return F.struct((at + F.length(x["m"])).alias("at"), F.array_append(acc["out"], F.struct(x["m"].alias("matched"), at.alias("offset"))).alias("out"))

    hits = folded(pairs, step, lambda x: x["g"] + F.length(x["m"]), none)
    return rows.where(F.col(text).rlike(java)).select("*", F.posexplode(hits).alias("ordinal", "hit")).select("*", "hit.matched", "hit.offset").drop("hit")


def line_of(text: Column, offset: Column) -> Column:
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def column_of(text: Column, offset: Column) -> Column:
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def snippet_of(text: Column, line: Column) -> Column:
    whole = F.regexp_replace(F.get(F.split(text, "\n"), line - 1), "\r\\z", "")
    return F.when(F.length(whole) > SNIPPET, F.concat(F.left(whole, F.lit(SNIPPET)), F.lit("..."))).otherwise(whole)


def near(text: Column, offset: Column, matched: Column, pattern: str) -> Column:
    """Whether a second pattern matches within NEAR bytes of the match, outwards to whole characters."""
    before, after = F.substring(text, F.lit(1), offset), F.substring(text, offset + F.length(matched) + 1, F.length(text))
    enough = lambda cut: F.filter(F.sequence(F.lit(0), F.lit(NEAR)), lambda n: F.octet_length(cut(n)) >= NEAR)
    left = F.coalesce(F.right(before, F.get(enough(lambda n: F.right(before, n)), F.lit(0))), before)
    right = F.coalesce(F.left(after, F.get(enough(lambda n: F.left(after, n)), F.lit(0))), after)
    return F.concat(left, matched, right).rlike(to_java(pattern))


def long_lines(rows: DataFrame, text: str, threshold: int = 1000) -> DataFrame:
    """rows with a row for each line over the threshold in bytes: line, n_bytes."""
    lines = rows.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("k", "l"))
    size = F.octet_length(F.regexp_replace("l", "\r\\z", ""))
    return lines.withColumn("n_bytes", size).where(F.col("n_bytes") > threshold).withColumn("line", F.col("k") + 1).drop("k", "l")


def entropy(text: Column) -> Column:
    """Shannon's, in bits for each character, from the string's own characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def size_text(n: Column) -> Column:
    """Bytes for reading: B, KB or MB with one decimal."""
    one = lambda unit: F.bround(n / F.lit(unit), 1)  # noqa: E731  exact halves go to the even digit
    return F.when(n >= 1048576, F.format_string("%.1f MB", one(1048576.0))).when(n >= 1024, F.format_string("%.1f KB", one(1024.0))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def duration_seconds(text: Column) -> Column:
    """A duration such as 90, 1.5h or 10 mins in seconds; null when it isn't one."""
    shape = r"^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([A-Za-z]*)\s*$"
    unit = F.lower(F.regexp_extract(text, shape, 2))
    factor = F.when(unit.isin("", "s", "sec", "secs"), 1).when(unit.isin("m", "min", "mins"), 60).when(unit.isin("h", "hr", "hrs"), 3600).when(unit.isin("d", "day", "days"), 86400)
    return F.when(text.rlike(shape), F.regexp_extract(text, shape, 1).cast("double") * factor)

"""Operator 6 (native): document fingerprints by I-Match. A text's distinct terms within a band of inverse document
frequency are sorted and hashed once for each of many randomised subsets of the lexicon; two texts are alike to the
degree that these hashes agree.

Terms (runs of letters and digits, lower-cased) are known by their 64-bit hash. Document frequencies are counted over all documents in 2^18
cells chosen by bits of that hash, so the lexicon's band is a bitmap of fixed size whatever the vocabulary, and looking up a
term is a constant-time test in the row: no join, no shuffle of terms. A cell's count is the sum over its terms, so
rare terms may look more frequent than they are, by their share of the documents' distinct terms divided by 2^18; that is far below the band's upper
edge at any size of the corpus. Other bits of the hash choose the subsets: four levels with 32 disjoint random
subsets each, of 1/32, 1/128, 1/512 and 1/4096 of the lexicon, so that short and long texts both have subsets with a
few of their terms. Likeness is the share of agreeing hashes among the subsets that either text has terms in, at the
level where it is highest.

A text with fewer than `few` terms in the band is fingerprinted by all its terms. Defined results: an empty table gives no rows, and very long texts are read whole; a null text counts
as empty; it and any text without terms have the fingerprint of no terms. Equal texts have equal fingerprints; equal fingerprints have likeness one.
Repeated rows follow one another; null ids come last. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm.common import range_of, shuffle_partitions

CELLS = 18  # bits
SUBSETS = 32
#: (first bit of the hash, bits) of each level
LEVELS = ((0, 5), (5, 7), (12, 9), (21, 12))
EMPTY = 42  # what hashing an empty list gives


def _terms(text: Column) -> Column:
    """The hashes of a text's terms, distinct and sorted."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND((1 << CELLS) - 1)


def lexicon(docs: DataFrame, low: int = 2, high: float = 0.02) -> list[int]:
    """The band as a bitmap in 2^12 longs: cells whose documents number at least `low` and at most `high` of all."""
    cells = docs.select(F.array_distinct(F.transform(_terms(F.coalesce(F.col("text").cast("string"), F.lit(""))), _cell)).alias("cells"))
    total = docs.count()
    counts = cells.select(F.explode("cells").alias("cell")).groupBy("cell").count().where((F.col("count") >= low) & (F.col("count") <= max(high * total, low)))
    words = counts.groupBy(F.shiftright("cell", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 AS int)))").alias("bits"))
    found = [0] * (1 << CELLS - 6)
    for r in words.collect():  # 4096 rows at most
        found[r["at"]] = r["bits"]
    return found


def _hashes(text: Column, band: list[int], few: int) -> Column:
    """One hash for each subset of each level, over the text's sorted terms in it."""
    bits = F.split(F.lit(",".join(map(str, band))), ",").cast("array<long>")

    def inside(h: Column) -> Column:
        cell = _cell(h)
        return F.getbit(F.get(bits, F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(63).cast("int")) == 1

    chosen = F.transform(F.array(_terms(text)), lambda t: F.struct(t.alias("all"), F.filter(t, inside).alias("band")))
    chosen = F.transform(chosen, lambda t: F.when(F.size(t["band"]) >= few, t["band"]).otherwise(t["all"]))

    def level(terms: Column, first: int, width: int) -> Column:
        part = lambda h: F.shiftrightunsigned(h, first).bitwiseAND((1 << width) - 1)
        held = F.filter(terms, lambda h: part(h) < SUBSETS)
        return F.flatten(
            F.transform(
                F.array(held),
                lambda own: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: F.xxhash64(F.filter(own, lambda h: part(h) == s)).bitwiseAND(0xFFF).cast("int")),
            )
        )

    return F.flatten(F.transform(chosen, lambda t: F.concat(*[level(t, a, b) for a, b in LEVELS])))


def _written(hashes: str) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 3, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Of two columns of subset hashes, from 0 to 1."""

    def of(k: int) -> Column:
        pairs = F.zip_with(F.slice(a, SUBSETS * k + 1, SUBSETS), F.slice(b, SUBSETS * k + 1, SUBSETS), lambda x, y: F.when(x != y, 0).when(x != EMPTY, 1))
        got = F.aggregate(pairs, F.struct(F.lit(0).alias("same"), F.lit(0).alias("n")), lambda c, x: F.struct((c["same"] + F.coalesce(x, F.lit(0))).alias("same"), (c["n"] + x.isNotNull().cast("int")).alias("n")), lambda c: c["same"] / F.greatest(c["n"], F.lit(4)))
        return got

    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(*[of(k) for k in range(len(LEVELS))]))


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Every row of docs(doc_id, text) with the given columns, and as next_<column> those of the next document by
    descending id, after the last one the first. The texts are shuffled once, into id ranges cut at quantiles of all ids; the first row
    of each range also goes to the range before it."""
    n = min(4 * shuffle_partitions(docs.sparkSession), 1 << 16)  # quantiles stay cheap; a range's rows sort with spilling
    found = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(20 * n))).first()[0] or []
    rows = docs.withColumn("__b", range_of(F.col("doc_id"), sorted(set(found)))).withColumn("__o", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))).withColumn("__h", F.xxhash64("text"))
    heads = rows.groupBy("__b").agg(F.min(F.struct("__o", "__h")).alias("head"))  # a row for each range
    before = heads.select("head", F.coalesce(F.lag("__b").over(Window.orderBy(F.desc("__b"))), F.min("__b").over(Window.partitionBy())).alias("__to"))
    first = before.select(F.col("head.__o").alias("__o"), F.col("head.__h").alias("__h"), "__to")
    ghosts = rows.drop("__b").join(F.broadcast(first), ["__o", "__h"]).withColumnRenamed("__to", "__b").dropDuplicates(["__b"]).withColumn("__ghost", F.lit(1))
    order = Window.partitionBy("__b").orderBy("__ghost", "__o", "__h")
    both = rows.withColumn("__ghost", F.lit(0)).unionByName(ghosts).withColumns(columns)
    out = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("__ghost = 0")
    return out.drop("__b", "__o", "__h", "__ghost")


def fingerprints(docs: DataFrame, low: int = 2, high: float = 0.02, few: int = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    band = lexicon(rows, low, high)
    rows = with_next(rows, {"text": F.col("text"), "own": _hashes(F.col("text"), band, few)})
    size = F.length("text")
    part = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - part), F.substring(F.col("next_text"), F.lit(1), part))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    rows = rows.withColumn("changed", _hashes(F.col("edited"), band, few))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _written("own").alias("fingerprint"), _written("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )

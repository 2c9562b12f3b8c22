"""Changes of file trees: snapshots of (path, time, length) and what differs between two of them. Files that are overwritten in place are
seen as well as new ones; unchanged files are listed but never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.sources import files
from quillscan.streaming.landing import drop, exists, land

SNAPSHOT = "path string, modificationTime timestamp, length long"


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    out = None
    for f in folders:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(f)
        out = part if out is None else out.unionByName(part)
    return out.where(files.is_code(F.col("path")) | files.is_manifest(F.col("path")))


def snapshot(spark: SparkSession, folders: list[str], root: str, number: int) -> DataFrame:
    """The code files and manifests below the folders as they are now, kept as snapshot `number` of root (and taken anew when that batch is
    replayed); the one before the last is dropped."""
    if exists(spark, f"{root}/{number}"):
        drop(spark, f"{root}/{number}")
    now = land(_read(spark, folders).select("path", "modificationTime", "length").distinct(), root, str(number))
    drop(spark, f"{root}/{number - 2}")
    return now


def changed(spark: SparkSession, folders: list[str], root: str, number: int) -> DataFrame | None:
    """path, content of the files that are new or have another time or length than in snapshot number - 1; None: no file. Code files
    over the size limit and texts that aren't UTF-8 are left out.

    The difference is a merge of the two sorted snapshots (an anti-join on all three columns). The content is then read of
    these files alone: the range of their times reaches the reader, which opens no file outside it."""
    now = snapshot(spark, folders, root, number)
    before = f"{root}/{number - 1}"
    if exists(spark, before):
        now = now.join(spark.read.schema(SNAPSHOT).parquet(before), ["path", "modificationTime", "length"], "left_anti")
    span = now.agg(F.min("modificationTime").alias("a"), F.max("modificationTime").alias("b")).first()
    if span["a"] is None:
        return None
    found = _read(spark, folders).where(F.col("modificationTime").between(F.lit(span["a"]), F.lit(span["b"])))
    found = found.where(files.is_manifest(F.col("path")) | (F.col("length") <= files.MAX_BYTES))
    text = F.col("content").cast("string")
    return found.join(now.select("path"), "path", "left_semi").where(F.is_valid_utf8(text)).select("path", text.alias("content"))


def manifests(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, content of the manifests below the folders now, outside the directories the monitor prunes."""
    found = _read(spark, folders).where(files.is_manifest(F.col("path")))
    found = found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, files.IGNORED_BY_MONITOR))))
    text = F.col("content").cast("string")
    return found.where(F.is_valid_utf8(text)).select("path", text.alias("content"))

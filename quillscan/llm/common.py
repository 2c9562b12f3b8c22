"""What the training-data operators share: table access, durable cuts of lineage, stable sampling."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, else (local mode, as in tests) one of our own.
    On a cluster a machine's own folder would lose rows, so there the setting is needed."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillscan-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later stages survive lost executors without
    recomputing what lies above. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillscan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo folds; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def unit_hash(*cols: Column) -> Column:
    """A stable pseudo-random number in [0, 1) for each row, from its columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_starts(b: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where each run of equal keys begins in a frame sorted by them."""
    if not len(b):
        return []
    new = np.zeros(len(b), bool)
    new[0] = True
    for k in keys:
        v = b[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new).tolist()


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of a sorted partition, cut again so that no run of equal keys is split over two of them."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        at = group_starts(b, keys)[-1]
        if held and (at or any(held[-1][k].iat[-1] != b[k].iat[0] for k in keys)):
            cut = at
            yield pd.concat([*held, b.iloc[:cut]], ignore_index=True)
            held = [b.iloc[cut:]]
        elif at:
            yield b.iloc[:at].reset_index(drop=True)
            held = [b.iloc[at:]]
        else:
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def sliced(batches: Iterator[pd.DataFrame], text: str, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """The batches in slices of about so many characters of text, so that what a worker makes of them stays small."""
    for b in batches:
        part = b[text].str.len().fillna(0).cumsum().to_numpy() // chars
        for at in np.split(np.arange(len(b)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            if len(at):
                yield b.iloc[at[0] : at[-1] + 1].reset_index(drop=True)


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value: found by a coarse list of bounds and then within its part."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    longs = lambda b: F.split(F.lit(",".join(map(str, b))), ",").cast("array<long>") if b else F.array().cast("array<long>")
    low = lambda array: F.size(F.filter(array, lambda x: x <= value))
    coarse = low(longs(bounds[step - 1 :: step]))
    return coarse * step + low(F.slice(longs(bounds), coarse * step + 1, F.lit(step)))

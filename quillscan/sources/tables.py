"""Reading tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a table in few files is dealt over all cores.
SMALL = 256 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table, through Spark's own reader so that any Hadoop path works.

    A small table in fewer files than there are cores is dealt out evenly, as a single row group would otherwise keep one core
    busy. Larger tables are never shuffled for that: their own splits are enough."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(2 * cores)


def dealt_tasks(spark: SparkSession, sf_dir: str, name: str, task_bytes: int) -> int:
    """Tasks of about so many stored bytes of the named table, and two for each core at least."""
    size = int(str(spark.read.parquet(f"{sf_dir}/{name}.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // task_bytes))


def dealt_table(spark: SparkSession, sf_dir: str, name: str, task_bytes: int = 8 << 20) -> DataFrame:
    """The named table for work that costs far more than its reading: in even tasks of about so many stored bytes each, whatever its files and
    row groups, of which a large file may have few. Only the columns used are shuffled."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(dealt_tasks(spark, sf_dir, name, task_bytes))


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; it goes when the application ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillscan-')}"
    path = f"{found.rstrip('/')}/quillscan/own-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once to a shared folder and read from there, for results that several steps need."""
    path = f"{scratch(df.sparkSession)}/stored"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pd.DataFrame], text: str, chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The batches in slices of about so many characters of text: what a worker makes of one at a time stays small, however much a batch holds."""
    for b in batches:
        part = b[text].str.len().fillna(0).cumsum().to_numpy() // chars
        for at in np.split(np.arange(len(b)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            if len(at):
                yield b.iloc[at[0] : at[-1] + 1].reset_index(drop=True)

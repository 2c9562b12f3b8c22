"""Tables that one streaming query leaves for another: each batch lands as one folder, at once and once only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def drop(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def land(df: DataFrame, root: str, batch: str) -> DataFrame:
    """df as the folder `batch` of root. It is written beside it and renamed when whole, so readers see all of it or nothing; a batch that is
    there already (replayed after a failure) stays as it is."""
    spark, target = df.sparkSession, f"{root}/{batch}"
    if not exists(spark, target):
        staged = f"{root}.staged/{batch}-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        where, fs = _fs(spark, root)
        fs.mkdirs(where)
        if not fs.rename(_fs(spark, staged)[0], _fs(spark, target)[0]) and not exists(spark, target):
            raise OSError(f"{staged} can't be renamed to {target}")
    return spark.read.schema(df.schema).parquet(target)


def landings(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The stream of what lands below root."""
    where, fs = _fs(spark, root)
    fs.mkdirs(where)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(root)

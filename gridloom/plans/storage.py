"""Tables between steps: written to the storage that driver and executors share, then read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset, as in tests, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{base.rstrip('/')}/grid-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as Parquet: its lineage ends here and lost executors cost nothing that is done."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_output(spark: SparkSession, path: str):
    """(stream, close) of a new file on any file system that Spark knows."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)


def open_input(spark: SparkSession, path: str):
    """A file on any file system that Spark knows, to be read from any place."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)

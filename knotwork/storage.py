"""Shared storage for intermediate tables.

Every intermediate result is written below the folder named by
``spark.checkpoint.dir``, which the driver and all executors share, so a lost
executor never takes data with it and lineage is cut at each table.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; local sessions without one get a default."""
    root = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/knotwork/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def uri_of(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as executors outside the JVM need it."""
    target, fs = hadoop_path(spark, path)
    return fs.makeQualified(target).toString()


def make_folder(spark: SparkSession, path: str) -> str:
    target, fs = hadoop_path(spark, path)
    fs.mkdirs(target)
    return uri_of(spark, path)


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage)."""
    return materialize_at(df, label, compression)[0]


def materialize_at(df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_folder(spark, label)
    schema = df.schema
    df.write.parquet(path, compression=compression)
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing will read again."""
    target, fs = hadoop_path(spark, path)
    fs.delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so when the driver collects what referred to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop_path(spark, path)
    return fs.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    target, fs = hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

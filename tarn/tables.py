"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's checkpoint folder. Where neither is set, a local session (tests)
    takes a temporary folder; on a cluster that is an error, since executors would each write to a disk of their own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if found := spark.sparkContext.getCheckpointDir():
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = f"file://{tempfile.gettempdir()}/tarn-checkpoints"
    spark.sparkContext.setCheckpointDir(found)
    return found


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tarn-tables/{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, under this application's tables."""
    return f"{_own(spark)}/{tag}-{uuid.uuid4().hex}"


#: Bytes of input of a task in ``fewer_files``.
WRITE_BYTES = 128 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", setting.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def fewer_files(df: DataFrame) -> DataFrame:
    """A table of files, read in so few tasks that each has about WRITE_BYTES of input where splits are set smaller, but two for each core at
    least: what is written from it then are files of a useful size. For narrow plans: a join on top could be pushed below
    the coalescing and keep its hash tables for as long as a task runs."""
    conf, cores = df.sparkSession.conf, df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.coalesce(max(2 * cores, -(-splits * _bytes(conf.get("spark.sql.files.maxPartitionBytes")) // WRITE_BYTES)))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The tables stay under <shared folder>/tarn-tables/<application id>; ``clear_tables`` removes them.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Remove the tables that this application wrote to the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

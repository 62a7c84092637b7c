"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, one in the warehouse, which off a local master must not be a machine's own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"executors don't share {folder}: set spark.checkpoint.dir to a folder of the cluster")
    return f"{folder}/_checkpoints"


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/glossarium/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends there: what comes later survives lost executors without
    running the earlier stages again, and can be read several times.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def uncut(*tables: DataFrame) -> None:
    """Delete tables that cut() has made, once nothing that is still to run reads them."""
    for df in tables:
        _delete(df.sparkSession, df._cut_path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete every table that cut() has left for this application; for the owner of the session, once results are written."""
    _delete(spark, own_dir(spark))

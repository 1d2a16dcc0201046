"""Intermediate tables in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset and Spark runs inside one machine (tests), a new temporary folder is set;
    on a cluster a missing setting is an error, because executors don't share local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="servelens-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage, survives lost executors, prunes by ``partition_by``."""
    path = fresh_folder(df.sparkSession, name)
    write = df.write.option("compression", "zstd")
    (write.partitionBy(*partition_by) if partition_by else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

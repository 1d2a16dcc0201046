"""Sinks: the samples table, the line store and drift snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: days of samples kept by default.
RETENTION_DAYS = 30


def write_samples(samples: DataFrame, path: str, mode: str = "append", spread: int = 16) -> None:
    """Append samples as Parquet partitioned by metric and day.

    Rows are shuffled by (metric, day, salt), so a metric that holds a third of
    the rows is written by ``spread`` tasks and files stay few.
    """
    d = samples.withColumn("date", F.to_date("ts"))
    salt = F.pmod(F.xxhash64(F.to_json("labels")), F.lit(spread))
    (d.repartition("metric", "date", salt).sortWithinPartitions("metric", "date", "ts")
     .write.mode(mode).partitionBy("metric", "date").parquet(path))


def read_samples(spark: SparkSession, path: str, today: str | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """The samples table; ``today`` limits it to the retention window by partition pruning."""
    d = spark.read.parquet(path)
    if today is not None:
        d = d.where(F.col("date") > F.date_sub(F.lit(today).cast("date"), days))
    return d.select("metric", "labels", "ts", "value")


def write_log_jsonl(classified: DataFrame, path: str, mode: str = "append") -> None:
    """Append classified lines as JSON lines."""
    classified.write.mode(mode).json(path)


def stream_log_jsonl(classified: DataFrame, path: str, checkpoint: str, once: bool = False):
    """The same from a stream; ``once`` drains what is there and stops."""
    w = classified.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def write_snapshot(normalised: DataFrame, path: str) -> None:
    """Append a normalised cluster state, partitioned by source and save time."""
    normalised.write.mode("append").partitionBy("source", "saved_at").parquet(path)


def read_snapshot(spark: SparkSession, path: str, source: str, saved_at: str) -> DataFrame:
    """One saved state; compare any two with ``drift.compare_states``."""
    return spark.read.parquet(path).where((F.col("source") == source) & (F.col("saved_at") == F.to_timestamp(F.lit(saved_at))))

"""Op 5: shards through fixed virtual slots.

Rows are hashed into a fixed number of virtual slots.  Bytes are summed per
slot, and a small table maps slots to shards.  That table is versioned: a
rebalance writes a new version that moves only as many slots as it must, and a
row never has to be hashed again.

Defined cases: a null text is empty (size 1, crc 0); a null id is hashed like
any value; rows that repeat an id or are equal in all columns stay separate rows; an
empty table gives an empty result and an empty map.  Input columns that aren't
named here are left out of :func:`placed`, so clashing names can't arise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, scratch, text_or_empty

SLOTS = 4096


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row; the text itself goes no further."""
    text = text_or_empty()
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return slim.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot: at most ``slots`` rows, whatever the input."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def _least_loaded(slots: Column, loads: Column) -> Column:
    """Heaviest slot first, each to the shard with the least bytes so far (lowest number on ties)."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("done"))

    def step(acc, s):
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == at, x + s["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["done"], F.array(F.struct(s["virtual_slot"].alias("virtual_slot"), at.alias("shard")))).alias("done"))

    return F.aggregate(slots, start, step, lambda acc: acc["done"])


def _heaviest_first(which: Column) -> Column:
    """An aggregate: the slots for which ``which`` holds, as an array (bounded by the number of slots)."""
    one = F.struct((-F.col("bytes")).alias("k"), F.col("virtual_slot").alias("virtual_slot"))
    return F.transform(F.array_sort(F.collect_list(F.when(which, one))),
                       lambda s: F.struct((-s["k"]).alias("bytes"), s["virtual_slot"].alias("virtual_slot")))


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: virtual_slot, shard, bytes, n, version."""
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    placed_slots = (stats.agg(_heaviest_first(F.lit(True)).alias("slots"))
                    .select(F.explode(_least_loaded(F.col("slots"), zero)).alias("p")).select("p.*"))
    return stats.join(F.broadcast(placed_slots), "virtual_slot").withColumn("version", F.lit(1))


def rebalanced(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version for new bytes or another number of shards.

    A shard keeps its slots, heaviest first, while they fit the mean; the rest,
    slots of shards that are gone and new slots go to the least loaded shards.
    """
    known = stats.join(F.broadcast(old.select("virtual_slot", "shard", "version")), "virtual_slot", "left")
    w = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    kept = (known.withColumn("mean", mean).withColumn("upto", F.sum("bytes").over(w))
            .withColumn("stays", F.coalesce((F.col("shard") < shards) & (F.col("upto") <= F.col("mean")), F.lit(False))))
    loads = [F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == i), F.col("bytes"))), F.lit(0)).cast("long") for i in range(shards)]
    free = kept.agg(_heaviest_first(~F.col("stays")).alias("slots"), F.array(*loads).alias("loads"))
    moved = free.select(F.explode(_least_loaded(F.col("slots"), F.col("loads"))).alias("p")).select("p.*")
    last = old.agg(F.max("version")).first()[0] or 0
    to = kept.where("stays").select("virtual_slot", "shard").unionByName(moved)
    return stats.join(F.broadcast(to), "virtual_slot").withColumn("version", F.lit(last + 1))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds this version to the stored history; a version is one partition."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version, or the newest."""
    whole = spark.read.parquet(path)
    if version is None:
        version = whole.agg(F.max("version")).first()[0]
    return whole.where(F.col("version") == version)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every row with its shard and its gapless place in it.

    The place is the row's number inside its virtual slot plus the rows of the
    shard's earlier slots, so no shard is ever sorted as a whole.  The map has
    at most ``SLOTS`` rows, which bounds the broadcast.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return (numbered.join(F.broadcast(base), "virtual_slot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("base") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Shards of near equal bytes; the map used is stored, as version 1, in the shared folder."""
    rows = saved(measured(docs, slots), "shard-rows")
    path = f"{scratch(docs.sparkSession)}/shard-map-{uuid.uuid4().hex}"
    store_map(first_map(slot_bytes(rows), shards), path)
    history = docs.sparkSession.read.schema("virtual_slot int, bytes long, n long, shard int, version int").parquet(path)
    return placed(rows, history.where("version = 1"))

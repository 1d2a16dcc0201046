"""Ordered operators that never put a whole key into one task.

A window over ``partitionBy(key)`` sorts every row of a hot key in a single
task.  The helpers here cut each key into time slices, run the ordered work
inside ``(key, slice)`` and carry the state between slices through a summary
with one row per (key, slice).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SLICE = "_slice"


def micros(ts: str | Column) -> Column:
    """Event time in whole microseconds."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def with_slice(df: DataFrame, position: Column, length: int) -> DataFrame:
    """Add the slice number: ``position`` (an integer) cut every ``length``."""
    return df.withColumn(SLICE, F.floor(position / F.lit(length)).cast("bigint"))


def sliced(df: DataFrame, keys: list[str], position: Column, length: int) -> DataFrame:
    """Add ``_key``, a struct of keys and slice: null keys are equal in it, so they meet their summary again."""
    return with_slice(df, position, length).withColumn("_key", F.struct(*keys, SLICE)).drop(SLICE)


def across(keys: list[str]) -> WindowSpec:
    """The slices of a key in order."""
    return Window.partitionBy(*[F.col("_key")[k] for k in keys]).orderBy(F.col("_key")[SLICE])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where null equals null, as in ``groupBy``; a struct of keys keeps it one hash join."""
    if not keys:
        return left.join(right, [], how)
    right = right.select(F.struct(*keys).alias("_key"), *[c for c in right.columns if c not in keys])
    return left.withColumn("_key", F.struct(*keys)).join(right, "_key", how).drop("_key")


# Estimated bytes of input per task of a shuffle whose rows are sorted.
PER_TASK, MOST_TASKS = 256 * 1024, 4096


def dealt(df: DataFrame, *keys) -> DataFrame:
    """``df`` hashed by ``keys`` over a number of tasks that grows with its estimated size, before a sort by them.

    Rows of samples pack so well that what adaptive execution merges to one task's worth of shuffled bytes fills gigabytes
    when sorted; a number that is asked for is not merged.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, min(MOST_TASKS, -(-size // PER_TASK))), *keys)


def running_total(df: DataFrame, keys: list[str], order: list, amounts: dict[str, Column],
                  position: Column, length: int) -> DataFrame:
    """Running sums per key, inclusive of the row, in ``order``.

    ``amounts`` maps new column names to the summed expressions; ``position``
    must be non-decreasing in ``order``.
    """
    tmp = {f"_a_{n}": e for n, e in amounts.items()}
    d = sliced(df.withColumns(tmp), keys, position, length)
    per = d.groupBy("_key").agg(*[F.sum(t).alias(t) for t in tmp])
    before = across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("_key", *[
        F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"_c{t}") for t in tmp])
    inner = (Window.partitionBy("_key").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (d.join(carry, "_key")
            .withColumns({n: F.sum(f"_a_{n}").over(inner) + F.col(f"_c_a_{n}") for n in amounts})
            .drop("_key", *tmp, *[f"_c{t}" for t in tmp]))


def carry_forward(df: DataFrame, keys: list[str], order: list, values: dict[str, str],
                  position: Column, length: int, rank: Column) -> DataFrame:
    """Latest non-null value at or before each row (as-of fill), per key.

    ``values`` maps new column names to the source columns; ``rank`` is one
    orderable expression equivalent to ``order`` (used to pick the last value of
    a slice with a partial aggregate instead of a sort).
    """
    d = sliced(df, keys, position, length)
    per = d.groupBy("_key").agg(*[
        F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))),
                 F.when(F.col(c).isNotNull(), rank)).alias(f"_l_{n}")
        for n, c in values.items()])
    before = across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("_key", *[
        F.last(f"_l_{n}", ignorenulls=True).over(before)["v"].alias(f"_c_{n}") for n in values])
    inner = (Window.partitionBy("_key").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (d.join(carry, "_key")
            .withColumns({n: F.coalesce(F.last(c, ignorenulls=True).over(inner), F.col(f"_c_{n}"))
                          for n, c in values.items()})
            .drop("_key", *[f"_c_{n}" for n in values]))


def previous_row(df: DataFrame, keys: list[str], order: list, values: dict[str, str],
                 position: Column, length: int, rank: Column) -> DataFrame:
    """Value of the preceding row of the same key (``lag``), across slices."""
    d = sliced(df, keys, position, length)
    per = d.groupBy("_key").agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), rank).alias("_l"))
    seq = across(keys)
    carry = per.select("_key", F.lag("_l").over(seq).alias("_c"))
    inner = Window.partitionBy("_key").orderBy(*order)
    d = d.join(carry, "_key").withColumn("_first", F.row_number().over(inner) == 1)
    return (d.withColumns({n: F.when(F.col("_first"), F.col("_c")[n]).otherwise(F.lag(c).over(inner))
                           for n, c in values.items()})
            .drop("_key", "_c", "_first"))

"""Exact order statistics without sorting a group in one task.

:func:`order_statistics` selects values by rank in counting passes.  Each
pass is a partial aggregate over bins, so a group that holds a third of all
rows costs the same as many small ones: (1) logarithmic bins, (2) distinct values, by linear
sub-bin, inside the bins that hold a rank.  Both counts are written, so the input is read
twice for any number of groups, measures and ranks; what follows reads the counts alone.
The result is exact for any distribution; the bins only decide how
much data reaches the second count.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved
from .slices import join_on

SUB_BINS = 4096
PER_OCTAVE = 32


def nearest_rank_index(p: float):
    """``min(n - 1, int(p / 100 * n))`` (zero based), double arithmetic kept."""
    q = p / 100

    def index(n: Column) -> Column:
        return F.least(n - 1, F.floor(F.lit(q) * n).cast("bigint"))

    return index


def p95_minus_one_index(n: Column) -> Column:
    """``int(0.95 * n) - 1``; -1 wraps to the last value."""
    i = F.floor(F.lit(0.95) * n).cast("bigint") - 1
    return F.when(i < 0, n - 1).otherwise(i)


def _octave_bin(v: Column) -> Column:
    """Monotone coarse bin of a double; infinities share the outermost bins."""
    mag = F.floor((F.log2(F.least(F.greatest(F.abs(v), F.lit(1e-300)), F.lit(1e300))) + 1000.0) * PER_OCTAVE).cast("bigint")
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, mag + 1).otherwise(-mag - 1)


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict, count: str | None = None) -> DataFrame:
    """Values at given ranks per group: ``(by.., one column per rank, [count])``, ``count`` naming a column for the group's size.

    ``ranks`` maps a column name to a function from the group count to a
    zero-based rank (ascending).  Nulls and NaN are ignored; a group without
    values has no row.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *([F.struct(*by).alias("_group")] if by else []), F.col(value).cast("double").alias("_v"))
    d = d.withColumn("_b", _octave_bin(F.col("_v")))
    group = ["_group" for _ in by[:1]]  # one struct: null groups equal themselves in the joins below

    # pass 1: coarse bins
    bins = saved(d.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "rank-bins")
    seq = Window.partitionBy(*group).orderBy("_b")
    bins = bins.withColumns({
        "before": F.coalesce(F.sum("c").over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("c").over(Window.partitionBy(*group))})
    want = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), fn(F.col("n")).cast("bigint").alias("rank"))
                               for name, fn in ranks.items()]))
    goal = (bins.withColumn("w", want)
            .where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("c"))))
    goal = goal.select(*group, "_b", "lo", "hi", "n", F.col("w.name").alias("name"),
                       (F.col("w.rank") - F.col("before")).alias("rank"))
    picked = goal.groupBy(*group, "_b").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))

    # pass 2: distinct values of the picked bins, by linear sub-bin
    width = F.col("hi") - F.col("lo")
    sub = F.when((width > 0) & (width < float("inf")), F.least(F.floor((F.col("_v") - F.col("lo")) * (F.lit(float(SUB_BINS)) / width)),
                                    F.lit(SUB_BINS - 1))).otherwise(F.lit(0)).cast("int")
    values = saved(d.join(picked, [*group, "_b"]).withColumn("_s", sub).groupBy(*group, "_b", "_s", "_v").agg(F.count(F.lit(1)).alias("c")), "rank-values")
    subs = values.groupBy(*group, "_b", "_s").agg(F.sum("c").alias("c"))
    seq = Window.partitionBy(*group, "_b").orderBy("_s")
    subs = subs.withColumn("before", F.coalesce(
        F.sum("c").over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goal = goal.join(subs, [*group, "_b"]).where((F.col("rank") >= F.col("before"))
                                              & (F.col("rank") < F.col("before") + F.col("c")))
    goal = goal.select(*group, "_b", "_s", "n", "name", (F.col("rank") - F.col("before")).alias("rank"))
    vals = values.join(goal.select(*group, "_b", "_s").distinct(), [*group, "_b", "_s"], "left_semi")
    seq = Window.partitionBy(*group, "_b", "_s").orderBy("_v")
    vals = vals.withColumn("before", F.coalesce(
        F.sum("c").over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = goal.join(vals, [*group, "_b", "_s"]).where((F.col("rank") >= F.col("before"))
                                                   & (F.col("rank") < F.col("before") + F.col("c")))
    size = [F.first("n").alias(count)] if count else []
    out = hit.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in ranks], *size)
    return out.select("_group.*", *ranks, *([count] if count else [])) if by else out


def nearest_rank(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, ``{"p50": 50, ...}``."""
    return order_statistics(df, by, value, {n: nearest_rank_index(p) for n, p in ps.items()})


def p95_minus_one(df: DataFrame, by: list[str], value: str, name: str = "p95") -> DataFrame:
    """The off-by-one percentile of burst summaries."""
    return order_statistics(df, by, value, {name: p95_minus_one_index})


def percentiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles (``q`` in 0..1) from two order statistics each."""
    ranks = {}
    for name, q in qs.items():
        ranks[f"{name}_lo"] = lambda n, q=q: F.floor(F.lit(q) * (n - 1)).cast("bigint")
        ranks[f"{name}_hi"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1)).cast("bigint")
    j = order_statistics(df, by, value, ranks, count="_n")
    out = {}
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_n") - 1)
        out[name] = F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (pos - F.floor(pos))
    return j.select(*by, *[e.alias(n) for n, e in out.items()])


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, population std, sample std (0 for fewer than two), min, max, n."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("pstdev"),
        F.when(F.count(v) < 2, 0.0).otherwise(F.stddev_samp(v)).alias("stdev"),
        F.min(v).alias("min"), F.max(v).alias("max"))


def distinct_counts(df: DataFrame, by: list[str], cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; the sketch form never shuffles the values."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*by).agg(*[f(F.col(c)).alias(f"n_{c}") for c in cols])


def zero_fill(dim: DataFrame, facts: DataFrame, on: list[str], counts: list[str]) -> DataFrame:
    """Every row of ``dim`` with the ``counts`` of its facts, 0 where there are none; a null key meets a null key."""
    return join_on(dim, facts.select(*on, *counts), on, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def worst_first(df: DataFrame, status: str = "status", then: str = "node") -> DataFrame:
    """Order by down, unknown, degraded, up and then by node."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("down", "unknown", "degraded", "up")]), F.col(status))
    return df.orderBy(order, then)


def lowest_k(df: DataFrame, col: str, k: int = 8, tie: list[str] = ()) -> DataFrame:
    return df.orderBy(F.asc(col), *tie).limit(k)


def latest_n(df: DataFrame, ts: str, n: int, tie: list[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(ts), *tie).limit(n)

"""Cumulative bucket histograms and bucket quantiles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector as V
from .vector import labels_of

INF = "+Inf"


def le_text(bound: float) -> str:
    """Label text of a bound: ``10`` for 10.0, ``0.25`` for 0.25."""
    return str(int(bound)) if float(bound).is_integer() else repr(float(bound))


def to_histogram(df: DataFrame, col: str, bounds, by: list[str] = ()) -> DataFrame:
    """Observations -> ``(by.., le, value cumulative count)`` plus ``+Inf``.

    One partial aggregate with a conditional sum per bound; the bucket rows are
    unfolded after the shuffle, so every bound is present even when empty.
    """
    x = F.col(col)
    ok = x.isNotNull()
    sums = [F.sum(F.when(x <= F.lit(float(b)), 1).otherwise(0)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    agg = df.where(ok).groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("_n"))
    rows = [F.struct(F.lit(le_text(b)).alias("le"), F.col(f"_b{i}").cast("double").alias("value"))
            for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(INF).alias("le"), F.col("_n").cast("double").alias("value")))
    return agg.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.le", "_r.value")


def histogram_summary(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """The ``_sum`` and ``_count`` series of a histogram."""
    return df.where(F.col(col).isNotNull()).groupBy(*by).agg(
        F.sum(col).alias("total"), F.count(F.lit(1)).alias("observations"))


def _le(c: Column) -> Column:
    return F.when(c.isin(INF, "Inf", "+inf", "inf"), F.lit(float("inf"))).otherwise(F.expr("try_cast(le AS DOUBLE)"))


def histogram_quantile(q: float, vec: DataFrame) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that crosses the rank.

    ``vec`` carries an ``le`` label.  Rank in the ``+Inf`` bucket gives the last
    finite bound; an empty histogram gives null.  A group holds one row per
    bound, a fixed small number.
    """
    keys = ["t", *[c for c in labels_of(vec) if c != "le"]]
    ordered = vec.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct(_le(F.col("le")).alias("le"), F.col("value").alias("cum")))).alias("b"))
    total = F.element_at("b", -1)["cum"]
    ordered = ordered.withColumn("rank", F.lit(float(q)) * total)
    # index (1-based) of the first bucket whose cumulative count reaches the rank
    ordered = ordered.withColumn("i", F.size(F.filter("b", lambda x: x["cum"] < F.col("rank"))) + 1)
    hit = F.try_element_at("b", F.col("i"))
    prev = F.when(F.col("i") > 1, F.try_element_at("b", F.col("i") - 1))
    lower = F.coalesce(prev["le"], F.when(hit["le"] <= 0, hit["le"]).otherwise(F.lit(0.0)))
    below = F.coalesce(prev["cum"], F.lit(0.0))
    inside = lower + (hit["le"] - lower) * F.try_divide(F.col("rank") - below, hit["cum"] - below)
    value = (F.when((total.isNull()) | (total <= 0), F.lit(None).cast("double"))
             .when(hit["le"] == float("inf"), prev["le"])
             .when(hit["cum"] == below, hit["le"])
             .otherwise(inside))
    return ordered.select(*keys, value.alias("value"))


def bucket_fraction(buckets: DataFrame, counts: DataFrame, floor: float = 1.0,
                    on: list[str] | None = None) -> DataFrame:
    """Share of observations at or below a bound: bucket / max(count, floor)."""
    return V.arith(buckets, "/", V.clamp_min(counts, floor), on)

"""Service-level indicators, error budgets and burn rates.

All functions take rollups from :mod:`samples` (one row per series and bucket)
so several windows share one pass over the raw samples.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector as V
from . import exactsum as X
from .samples import Grid, increase, rate, sliding

# Allowed bad fractions and burn thresholds.
AVAILABILITY_BUDGET = 0.005
LATENCY_BUDGET = 0.05
LATENCY_BOUND = "10"
FAST_BURN = ("1h", 3600, 14.4)
SLOW_BURN = ("6h", 21600, 3.0)


def _or_hundred(v: DataFrame, grid: Grid, spark) -> DataFrame:
    return V.vec_or(v, V.constant(spark, grid, 100.0), on=[])


def _bad_share(errors: DataFrame, requests: DataFrame, window: int, grid: Grid, floor: float) -> DataFrame:
    return V.arith(increase(errors, window, grid, by=[]), "/",
                   V.clamp_min(increase(requests, window, grid, by=[]), floor), on=[])


def availability_sli(errors5xx: DataFrame, requests: DataFrame, window: int, grid: Grid) -> DataFrame:
    """100 * max(1 - 5xx / max(requests, 1), 0), 100 where there is no data."""
    v = V.clamp_min(V.scalar(_bad_share(errors5xx, requests, window, grid, 1.0), "-", 1.0, swap=True), 0.0)
    return _or_hundred(V.scalar(v, "*", 100.0), grid, requests.sparkSession)


def availability_budget_left(errors5xx: DataFrame, requests: DataFrame, window: int, grid: Grid,
                             budget: float = AVAILABILITY_BUDGET) -> DataFrame:
    v = V.scalar(_bad_share(errors5xx, requests, window, grid, 1.0), "/", budget)
    v = V.clamp_min(V.scalar(v, "-", 1.0, swap=True), 0.0)
    return _or_hundred(V.scalar(v, "*", 100.0), grid, requests.sparkSession)


def _good_share(le_bound: DataFrame, count: DataFrame, window: int, grid: Grid, floor: float,
                per_second: bool = False) -> DataFrame:
    f = rate if per_second else increase
    good = V.arith(f(le_bound, window, grid, by=[]), "/",
                   V.clamp_min(f(count, window, grid, by=[]), floor), on=[])
    return V.clamp_min(good, 0.0)


def latency_sli(le_bound: DataFrame, count: DataFrame, window: int, grid: Grid) -> DataFrame:
    """Share (in %) of observations at or below the latency bound."""
    return _or_hundred(V.scalar(_good_share(le_bound, count, window, grid, 1.0), "*", 100.0),
                       grid, count.sparkSession)


def latency_budget_left(le_bound: DataFrame, count: DataFrame, window: int, grid: Grid,
                        budget: float = LATENCY_BUDGET) -> DataFrame:
    bad = V.scalar(_good_share(le_bound, count, window, grid, 1.0), "-", 1.0, swap=True)
    v = V.clamp_min(V.scalar(V.scalar(bad, "/", budget), "-", 1.0, swap=True), 0.0)
    return _or_hundred(V.scalar(v, "*", 100.0), grid, count.sparkSession)


def burn_rates(bad: DataFrame, total: DataFrame, windows: dict[str, int], grid: Grid, budget: float,
               floor: float = 0.0001, invert: bool = False) -> DataFrame:
    """Burn rate for several windows in one pass: ``(t, window, burn, traffic)``.

    ``bad`` and ``total`` are counter rollups; both are stacked under a side
    label so a single windowed pass serves every window.
    ``invert=True`` reads ``bad`` as the good count (latency buckets).
    """
    cols = ["t", "_band", "_n", "_units"]
    both = bad.select(F.lit("bad").alias("side"), *cols).unionByName(total.select(F.lit("all").alias("side"), *cols))
    s = sliding(both, ["side"], windows, grid, label="window").withColumn("v", X.total(F.col("_parts")))
    s = s.groupBy("t", "window").agg(*[F.max(F.when(F.col("side") == x, F.col("v"))).alias(x) for x in ("bad", "all")])
    secs = F.create_map(*[x for k, w in windows.items() for x in (F.lit(k), F.lit(float(w)))])[F.col("window")]
    r_bad, r_all = F.col("bad") / secs, F.coalesce("all", F.lit(0.0)) / secs
    share = r_bad / F.greatest(r_all, F.lit(floor))
    if invert:
        share = 1.0 - F.greatest(share, F.lit(0.0))
    return s.where("bad is not null").select("t", "window", (share / budget).alias("burn"), r_all.alias("traffic"))


def burn_alerts(burns: DataFrame, thresholds: dict[str, float], strict: bool = True) -> DataFrame:
    """Windows whose burn passes its threshold while traffic flows."""
    limit = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("window")]
    hit = F.col("burn") > limit if strict else F.col("burn") >= limit
    return burns.where(hit & (F.col("traffic") > 0)).select("t", "window", F.col("burn").alias("value"))


def budget_exhausted(errors5xx: DataFrame, requests: DataFrame, window: int, grid: Grid,
                     budget: float = AVAILABILITY_BUDGET) -> DataFrame:
    """Budget of the whole window consumed (burn >= 1) with traffic."""
    v = V.cmp(V.scalar(_bad_share(errors5xx, requests, window, grid, 0.0001), "/", budget), ">=", 1.0)
    return V.vec_and(v, V.cmp(increase(requests, window, grid, by=[]), ">", 0.0), on=[])


def traffic_gate(v: DataFrame, traffic: DataFrame, on: list[str]) -> DataFrame:
    """Keep the vector only where requests flow."""
    return V.vec_and(v, V.cmp(traffic, ">", 0.0), on)


def baseline_compare(now: DataFrame, base: DataFrame, op: str, factor: float, eps: float,
                     on: list[str]) -> DataFrame:
    """``now op factor * (baseline + eps)``; the baseline is an offset vector."""
    return V.cmp(now, op, V.scalar(V.scalar(base, "+", eps), "*", factor), on)

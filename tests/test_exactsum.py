"""Sums that can be taken apart again, against exact fractions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from servelens.operators import exactsum as X
from servelens.operators import samples as S

from test_samples import BASE, GRID, frame


def exact(values):
    if any(math.isnan(v) for v in values) or {math.inf, -math.inf} <= set(values):
        return math.nan
    for v in values:
        if math.isinf(v):
            return v
    return float(sum(map(Fraction, values)))


def summed(spark, groups):
    d = spark.createDataFrame([(i, float(v)) for i, g in enumerate(groups) for v in g], "i int, value double").repartition(3)
    d = d.withColumn("band", X.band(F.col("value"))).withColumn("units", X.units(F.col("value"), F.col("band")))
    per = d.groupBy("i", "band").agg(F.sum("units").cast(X.UNITS).alias("units"))
    got = {r.i: r.v for r in per.groupBy("i").agg(X.total(F.collect_list(F.struct("band", "units"))).alias("v")).collect()}
    return [got[i] for i in range(len(groups))]


def test_sums_of_any_size(spark):
    rng = random.Random(4)
    groups = [[3e-13], [1e17, 1e17], [1e17, 3e-13, -1e17], [0.1] * 10, [1e308, -1e308, 5e-324], [5e-324] * 3, [math.inf, 1.0], [-math.inf, 2.0],
              [math.inf, -math.inf], [math.nan, 1.0], [0.0, -0.0], [2.0**-8, 2.0**24, -2.0**56], [1.7976931348623157e308], [-1.0, 2.0**-40], [2.0**40, -1.0, 2.0**-60],
              [2.0**100, 1.0, -2.0**100]]
    groups += [[rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    groups += [[rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-90, 90) for _ in range(rng.randint(2, 40))] for _ in range(60)]
    groups += [[2.0**e, 2.0**e * (1 - 2.0**-53), -(2.0**e)] for e in range(-300, 300, 7)]
    for got, g in zip(summed(spark, groups), groups, strict=True):
        want = exact(g)
        assert (math.isnan(got) and math.isnan(want)) or got == want or abs(got - want) <= math.ulp(want), g


def test_what_is_added_can_be_taken_away(spark):
    rng = random.Random(5)
    values = [rng.random() * 10.0 ** rng.randint(-200, 200) for _ in range(50)]
    assert summed(spark, [values + [-v for v in values] + [7.0]]) == [7.0]


EXTREMES = [("inf", 0, math.inf), ("inf", 60, 1.0), ("tiny", 0, 3e-13), ("tiny", 60, 3e-13), ("huge", 0, 1e17), ("huge", 60, 3e17),
            ("nan", 0, math.nan), ("nan", 120, 4.0), ("both", 0, math.inf), ("both", 30, -math.inf), ("mixed", 0, 1e17), ("mixed", 30, 0.25), ("mixed", 600, 0.5)]


def test_means_of_extreme_values(spark):
    v = S.avg_over_time(S.value_rollup(frame(spark, EXTREMES), 60), 120, GRID)
    got = {(r.s, r.t - BASE): r.value for r in v.collect()}
    assert got["inf", 60] == math.inf and got["inf", 120] == 1.0  # drained: the infinity has left
    assert got["tiny", 60] == 3e-13 and got["huge", 60] == 2e17
    assert math.isnan(got["nan", 60]) and got["nan", 120] == 4.0
    assert math.isnan(got["both", 60])
    assert got["mixed", 60] == (1e17 + 0.25) / 2 and got["mixed", 120] == 0.25 and got["mixed", 660] == 0.5


def test_increases_of_extreme_counters(spark):
    rows = [("a", 0, 0.0), ("a", 60, 1e17), ("a", 120, 1e17), ("a", 180, 1e17 + 64), ("b", 0, 0.0), ("b", 30, 3e-13), ("b", 60, 9e-13),
            ("c", 0, 1.0), ("c", 60, math.inf), ("c", 120, math.inf), ("c", 180, 5.0), ("c", 240, 6.0)]
    got = {(r.s, r.t - BASE): r.value for r in S.increase(S.counter_increments(frame(spark, rows), 60), 60, GRID).collect()}
    assert [got["a", t] for t in (60, 120, 180)] == [1e17, 0.0, 64.0]
    assert got["b", 60] == pytest.approx(9e-13, rel=1e-15)
    assert [got["c", t] for t in (60, 120, 180, 240)] == [math.inf, 0.0, 5.0, 1.0]
    run = {(r.s, r.t - BASE): r.value for r in S.total_across_resets(S.counter_increments(frame(spark, rows), 60)).collect()}
    assert run["a", 180] == 1e17 + 64 and run["b", 60] == pytest.approx(9e-13, rel=1e-15) and run["c", 240] == math.inf


def test_labels_may_be_named_like_figures(spark):
    d = frame(spark, [("x", 0, 1.0), ("x", 60, 3.0)]).withColumnRenamed("s", "n").withColumns({"total": F.lit("a"), "last": F.lit("b"), "inc": F.lit("c")})
    r = S.increase(S.counter_increments(d, 60), 300, GRID).where(F.col("t") == BASE + 60).first()
    assert (r.n, r.total, r.last, r.inc, r.value) == ("x", "a", "b", "c", 2.0)


def test_one_shuffle_per_step(spark):
    """Raw rows are shuffled once; a window adds the sum by group and bucket, the events, and one deal by group."""
    d = spark.range(1000).select((F.col("id") % 5).cast("string").alias("s"), F.timestamp_seconds(F.lit(BASE) + F.col("id")).alias("ts"), F.rand(1).alias("value"))
    v = S.avg_over_time(S.value_rollup(d, 60), 300, GRID)
    plan = v._jdf.queryExecution().sparkPlan().toString()
    full = v._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and full.count("Exchange") <= 4

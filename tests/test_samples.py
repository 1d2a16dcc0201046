"""Time-series operators against brute force, and their invariants."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servelens.operators import histograms as H
from servelens.operators import samples as S
from servelens.operators import vector as V
from servelens.operators.slices import dealt
from suite.adapters import bucket_counts
from suite.serving import ByMetric

BASE = 1_704_067_200
GRID = S.Grid(BASE, BASE + 1800, 60)


def at(sec):
    return dt.datetime.fromtimestamp(BASE + sec, dt.timezone.utc).replace(tzinfo=None)


def frame(spark, rows):
    return spark.createDataFrame([(s, at(t), float(v)) for s, t, v in rows], "s string, ts timestamp, value double")


def brute_increments(rows):
    out, last = [], {}
    for s, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        p = last.get(s)
        out.append((s, t, 0.0 if p is None else (v - p if v >= p else v)))
        last[s] = v
    return out


def brute_window(rows, w, f):
    out = {}
    for t in range(0, 1801, 60):
        for s in {r[0] for r in rows}:
            vals = [r for r in rows if r[0] == s and t - w < r[1] <= t]
            if vals:
                out[(s, BASE + t)] = f(vals)
    return out


series = st.lists(st.tuples(st.sampled_from("ab"), st.integers(-400, 2200), st.integers(0, 9)), min_size=1, max_size=40, unique_by=lambda r: (r[0], r[1]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=series, w=st.sampled_from([60, 300, 1200]))
def test_windows_match_brute_force(spark, rows, w):
    inc = brute_increments(rows)
    got = {(r.s, r.t): r.value for r in S.increase(S.counter_increments(frame(spark, rows), 60), w, GRID).collect()}
    assert got == brute_window(inc, w, lambda v: sum(x[2] for x in v))
    roll = S.gauge_rollup(frame(spark, rows), 60)
    got = {(r.s, r.t): r.value for r in S.instant(roll, GRID, w).collect()}
    assert got == brute_window(rows, w, lambda v: float(max(v, key=lambda x: x[1])[2]))
    roll = S.value_rollup(frame(spark, rows), 60)
    got = {(r.s, r.t): r.value for r in S.avg_over_time(roll, w, GRID).collect()}
    want = brute_window(rows, w, lambda v: sum(x[2] for x in v) / len(v))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_increments_are_additive_over_windows(spark):
    rnd = random.Random(1)
    rows = [("a", t, rnd.randint(0, 50)) for t in range(1, 1800, 7)]
    roll = S.counter_increments(frame(spark, rows), 60)
    whole = S.increase(roll, 1800, S.Grid(BASE + 1800, BASE + 1800, 1800)).first().value
    parts = S.increase(roll, 300, S.Grid(BASE, BASE + 1800, 300)).agg(F.sum("value")).first()[0]
    assert whole == parts


def test_drained_window_is_exactly_zero(spark):
    rows = [("a", t, 0.1 * t) for t in range(0, 600, 10)] + [("a", t, 59.0) for t in range(600, 1800, 60)]
    v = S.increase(S.counter_increments(frame(spark, rows), 60), 300, GRID).where(F.col("t") > BASE + 960)
    assert {r.value for r in v.collect()} == {0.0}


def test_nan_never_compares(spark):
    d = spark.createDataFrame([(1, "a", float("nan")), (1, "b", 2.0)], "t bigint, x string, value double")
    assert [r.x for r in V.cmp(d, ">", 1).collect()] == ["b"]


def test_grid_must_align():
    with pytest.raises(ValueError):
        S.Grid(1, 60, 60)


def test_strict_matching_never_matches_different_labels(spark):
    left = spark.createDataFrame([(1, "m", "n", 1.0)], "t bigint, model string, node string, value double")
    right = spark.createDataFrame([(1, "m", 1.0)], "t bigint, model string, value double")
    assert V.vec_and(left, right).count() == 0
    assert V.vec_and(left, right, on=["model"]).count() == 1
    assert V.vec_and(left, right, on=[]).count() == 1


def test_or_keeps_left_and_fills(spark):
    left = spark.createDataFrame([(1, 5.0)], "t bigint, value double")
    v = V.vec_or(left, V.constant(spark, S.Grid(0, 2, 1), 9.0), on=[])
    assert sorted((r.t, r.value) for r in v.collect()) == [(0, 9.0), (1, 5.0), (2, 9.0)]


def buckets(spark, rows):
    return spark.createDataFrame([(1, le, float(c)) for le, c in rows], "t bigint, le string, value double")


@pytest.mark.parametrize("q,rows,want", [
    (.5, [("1", 0), ("2", 10), ("+Inf", 10)], 1.5), (.5, [("1", 10), ("2", 10), ("+Inf", 10)], .5),
    (.99, [("1", 1), ("2", 2), ("+Inf", 10)], 2.0), (.5, [("1", 0), ("+Inf", 0)], None)])
def test_quantile(spark, q, rows, want):
    assert H.histogram_quantile(q, buckets(spark, rows)).first().value == want


def test_quantile_is_monotone(spark):
    b = buckets(spark, [("0.5", 3), ("1", 9), ("5", 20), ("+Inf", 24)])
    vals = [H.histogram_quantile(q / 10, b).first().value for q in range(1, 10)]
    assert vals == sorted(vals)


def test_histogram_covers_every_bound(spark):
    d = spark.createDataFrame([(0.3,), (2.0,), (7.5,), (None,)], "x double")
    got = {r.le: r.value for r in H.to_histogram(d, "x", (0.5, 1, 5, 10)).collect()}
    assert got == {"0.5": 1, "1": 1, "5": 2, "10": 3, "+Inf": 3}


def test_bind_variables_escapes():
    assert S.bind_variables({"m": "a.b", "n": None, "t": ["x", "y+"]}) == {"m": r"a\.b", "n": ".*", "t": r"x|y\+"}


def test_sorted_shuffles_grow_with_their_input(spark):
    small, large = (spark.range(n).select("id", (F.col("id") % 50).alias("k")) for n in (10, 1_000_000))
    assert dealt(small, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt(large, "k").rdd.getNumPartitions() > 10 * spark.sparkContext.defaultParallelism


def test_bucket_counts_sort_a_row_per_event(spark):
    rows = [(i, i % 2, i // 7, dt.datetime(2024, 1, 1, 0, 0, i), i * 13 % 10) for i in range(20)]
    d = spark.createDataFrame(rows, "event_id bigint, model bigint, day bigint, ts timestamp, x bigint").withColumn("us", F.unix_micros("ts"))
    got = bucket_counts(d, "x", (2.0, 5.0), ["model"])
    want = sorted((m, le, at, float(sum(1 for r in rows if r[1:3] == (m, day) and r[0] <= e and r[4] <= b)))
                  for e, m, day, at, _ in rows for le, b in (("2", 2), ("5", 5), ("+Inf", 99)))
    assert sorted((r.model, r.le, r.ts, r.value) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # unfolded above the window


def test_null_samples_and_drops_inside_a_bucket(spark):
    """A null sample is none: what follows it still grows from the sample before."""
    d = spark.createDataFrame([("a", t, v) for t, v in [(1, 0.0), (2, 10.0), (3, None), (4, 30.0), (5, 4.0), (6, 9.0)]], "s string, x int, value double")
    d = d.select("s", F.timestamp_seconds(F.lit(BASE) + F.col("x")).alias("ts"), "value")
    got = S.counter_increments(d, 60).groupBy("t").agg(F.sum("_n").alias("n")).collect()
    assert [(r.t - BASE, r.n) for r in got] == [(60, 5)]  # four steps and the first sample
    assert S.increase(S.counter_increments(d, 60), 60, GRID).first().value == 39.0


def test_label_pairs_tell_the_series_that_the_text_tells(spark):
    rows = [({"b": "1", "a": "2"},), ({"a": "2", "b": "1", "c": None},), ({},), ({"a": None},), (None,), ({"a": 'x", "b'},)]
    d = spark.createDataFrame(rows, "labels map<string,string>")
    got = d.select(S.label_pairs(F.col("labels")).alias("p"), S.normalise_labels(F.col("labels")).alias("text"))
    for r in got.select("text", S.pairs_text(F.col("p")).alias("again")).collect():
        assert r.text == r.again
    assert got.groupBy("p").agg(F.count_distinct(F.coalesce("text", F.lit("null"))).alias("n")).where("n > 1").count() == 0
    assert got.select("p").distinct().count() == got.select("text").distinct().count()


def test_gauges_of_a_metric_source_share_a_pass(spark):
    calls = spark.createDataFrame([(i, f"n{i % 2}", float(i)) for i in range(6)], "x int, node string, v double").withColumn("ts", F.timestamp_seconds(F.lit(BASE) + F.col("x")))
    one = lambda name: F.struct(F.lit(name).alias("metric"), F.create_map(F.lit("node"), F.col("node")).alias("labels"), F.col("v").alias("value"))
    source = ByMetric(calls, GRID, calls=calls, gauges={"g": [one("g")], "h": [F.when(F.col("x") > 3, one("h"))]})
    got = source.samples_of(["g", "h"])
    assert got.columns == ["metric", "labels", "ts", "value"]
    assert sorted((r.metric, r.labels["node"], r.value) for r in got.collect()) == sorted([*[("g", f"n{i % 2}", float(i)) for i in range(6)], ("h", "n0", 4.0), ("h", "n1", 5.0)])

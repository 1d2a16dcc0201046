"""Rank selection, sliced windows and joins against brute force."""

import datetime as dt
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servelens.operators import benchruns as B
from servelens.operators import logs as LG
from servelens.operators import slices as SL
from servelens.operators import stats as ST

values = st.lists(st.one_of(st.floats(-1e6, 1e6, allow_nan=False), st.integers(-3, 3).map(float), st.just(0.0)), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=values, b=values)
def test_nearest_rank(spark, a, b):
    d = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    got = {r.g: (r.p50, r.p95, r.p99) for r in ST.nearest_rank(d, ["g"], "v", {"p50": 50, "p95": 95, "p99": 99}).collect()}
    for g, vals in (("a", sorted(a)), ("b", sorted(b))):
        assert got[g] == tuple(vals[min(len(vals) - 1, int(p / 100 * len(vals)))] for p in (50, 95, 99))


@pytest.mark.parametrize("n", [1, 2, 19, 20, 41])
def test_p95_minus_one(spark, n):
    vals = random.Random(n).sample(range(1000), n)
    d = spark.createDataFrame([("a", float(v)) for v in vals], "g string, v double")
    assert ST.p95_minus_one(d, ["g"], "v").first().p95 == sorted(vals)[int(.95 * n) - 1]


def test_one_value_holding_most_rows(spark):
    d = spark.range(20000).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, F.col("id") / 7).otherwise(5.0).alias("v"))
    vals = sorted(r.v for r in d.collect())
    r = ST.nearest_rank(d, ["g"], "v", {"p10": 10, "p50": 50, "p90": 90}).first()
    assert (r.p10, r.p50, r.p90) == tuple(vals[int(p / 100 * len(vals))] for p in (10, 50, 90))


def test_infinite_values_rank_last(spark):
    d = spark.createDataFrame([("a", v) for v in (1.0, float("inf"), -float("inf"), 2.0, float("nan"))], "g string, v double")
    r = ST.nearest_rank(d, ["g"], "v", {"lo": 0, "mid": 50, "hi": 99}).first()
    assert (r.lo, r.mid, r.hi) == (-float("inf"), 2.0, float("inf"))


def test_percentiles_and_moments(spark):
    vals = [random.Random(3).random() * 100 for _ in range(101)] + [7.0]
    d = spark.createDataFrame([("a", v) for v in vals], "g string, v double")
    want = statistics.quantiles(vals, n=10, method="inclusive")
    r = ST.percentiles(d, ["g"], "v", {"d1": .1, "d5": .5, "d9": .9}).first()
    assert (r.d1, r.d5, r.d9) == pytest.approx((want[0], want[4], want[8]))
    m = ST.moments(d, ["g"], "v").first()
    assert (m.mean, m.pstdev, m.stdev) == pytest.approx((statistics.mean(vals), statistics.pstdev(vals), statistics.stdev(vals)))
    assert ST.moments(d.limit(1), ["g"], "v").first().stdev == 0.0


def rows(n, seed=0):
    rnd = random.Random(seed)
    return [(rnd.choice("xy"), i, rnd.randint(0, 500), rnd.choice([None, rnd.randint(0, 9)])) for i in range(n)]


@pytest.mark.parametrize("length", [1, 7, 100, 10_000])
def test_sliced_windows(spark, length):
    data = rows(300)
    d = spark.createDataFrame(data, "k string, i bigint, p bigint, v int")
    order, rank = ["p", "i"], F.struct("p", "i")
    run = {r.i: r.total for r in SL.running_total(d, ["k"], order, {"total": F.coalesce("v", F.lit(0))}, F.col("p"), length).collect()}
    last = {r.i: r.last for r in SL.carry_forward(d, ["k"], order, {"last": "v"}, F.col("p"), length, rank).collect()}
    prev = {r.i: r.before for r in SL.previous_row(d, ["k"], order, {"before": "v"}, F.col("p"), length, rank).collect()}
    for k in "xy":
        total, carried, before = 0, None, None
        for _, i, _, v in sorted((r for r in data if r[0] == k), key=lambda r: (r[2], r[1])):
            total += v or 0
            carried = carried if v is None else v
            assert (run[i], last[i], prev[i]) == (total, carried, before)
            before = v


def ts(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_asof_takes_the_latest_at_or_before(spark):
    r = spark.createDataFrame([("g", ts(5), 1), ("g", ts(10), 2), ("g", ts(99999), 3), ("h", ts(3), 4)], "g string, ts timestamp, id int")
    s = spark.createDataFrame([("g", ts(6), 1.0), ("g", ts(10), 2.0), ("g", ts(11), 3.0)], "g string, ts timestamp, mem double")
    got = {x.id: x.mem for x in B.asof_snapshot(r, s, ["g"], ["mem"], slice_seconds=60).collect()}
    assert got == {1: None, 2: 2.0, 3: 3.0, 4: None}


@pytest.mark.parametrize("bucket", [1, 10, 1000])
def test_interval_join_has_no_duplicates(spark, bucket):
    rnd = random.Random(5)
    req = [(i, s := rnd.randint(0, 900), s + rnd.randint(0, 60)) for i in range(80)]
    crash = [(i, rnd.randint(0, 1000)) for i in range(30)]
    r = spark.createDataFrame([(i, ts(a), ts(b)) for i, a, b in req], "rid int, start_ts timestamp, end_ts timestamp")
    c = spark.createDataFrame([(i, ts(t)) for i, t in crash], "cid int, crash_ts timestamp")
    got = sorted((x.cid, x.rid) for x in B.crash_request_join(c, r, 5, bucket).collect())
    assert got == sorted((ci, ri) for ci, t in crash for ri, a, b in req if a <= t <= b + 5)


def test_bench_and_sweep_known_answers(spark):
    d = spark.createDataFrame([("c1", True, 1.0, 2.0, 10.0, 20), ("c1", True, 3.0, 4.0, 30.0, 40), ("c1", False, None, 8.0, None, None)],
                              "label string, ok boolean, ttft double, total double, tps double, comp_tokens int")
    r = B.bench_summary(d, ["label"]).first()
    assert (r.requests, r.errors, r.error_rate, r.ttft_p50, r.total_p95, r.throughput_tok_s, r.wall_s) == (3, 1, .3333, 3.0, 4.0, 7.5, 8.0)
    stock, batched = (spark.createDataFrame(x, "level int, tok double") for x in (
        [(1, 8.3), (2, 8.9), (4, 9.7), (8, 8.5), (16, 7.0)], [(1, 21.0), (2, 37.9), (4, 46.9), (8, 39.2), (16, 59.4)]))
    got = {x.level: round(x.ratio, 1) for x in B.sweep_compare(stock, batched, "level", "tok").collect()}
    assert got == {1: 2.5, 2: 4.3, 4: 4.8, 8: 4.6, 16: 8.5}


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 1, 5.0), (None, 900, 7.0)], "g string, t bigint, v double")
    got = {r.g: (r.low, r.high) for r in ST.order_statistics(df, ["g"], "v", {"low": lambda n: n * 0, "high": lambda n: n - 1}).collect()}
    assert got == {"a": (1.0, 3.0), None: (5.0, 7.0)}
    assert {r.g: r.m for r in ST.percentiles(df, ["g"], "v", {"m": 0.5}).collect()} == {"a": 2.0, None: 6.0}
    sums = SL.running_total(df, ["g"], ["t"], {"s": F.col("v")}, F.col("t"), 10).orderBy("s").collect()
    assert [(r.g, r.t, r.s) for r in sums] == [("a", 1, 1.0), ("a", 2, 4.0), (None, 1, 5.0), (None, 900, 12.0)]
    before = SL.previous_row(df, ["g"], ["t"], {"p": "v"}, F.col("t"), 10, F.col("t")).collect()
    assert {(r.g, r.t): r.p for r in before} == {("a", 1): None, ("a", 2): 1.0, (None, 1): None, (None, 900): 5.0}


def test_the_input_is_read_twice(spark, tmp_path):
    """Two counts of the input, whatever the number of ranks; the rest reads what they wrote."""
    spark.range(500).select((F.col("id") % 3).alias("g"), F.rand(2).alias("v")).write.parquet(str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    d = spark.read.parquet(str(tmp_path / "in")).coalesce(1).mapInArrow(counted, "g long, v double")
    got = ST.percentiles(d, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.999})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 3 and reads.value == 2 and "MapInArrow" not in plan


def test_serving_states_read_events_twice(spark):
    d = spark.range(50).select(F.lit("s").alias("source"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.lit("ok").alias("event")).mapInArrow(lambda b: b, "source string, ts timestamp, seq long, event string")
    plan = LG.serving_states(d, 10)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Window") <= 8

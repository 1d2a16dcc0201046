"""Alert states, routing, grouping, annotations; rules and boards on shared roll-ups."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servelens.naming import DEFAULT_NAMING
from servelens.operators import alerts as A
from servelens.operators import samples as S
from servelens.plans import dashboards as DB
from servelens.plans import rules as R
from servelens.plans.rollups import needs
from servelens.plans.source import Source


def test_hold_time_and_reset(spark):
    ts = [0, 30, 60, 90, 150, 180, 210]
    c = spark.createDataFrame([(t, "a", 1.0) for t in ts], "t bigint, node string, value double")
    got = [(r.t, r.state, r.active_since) for r in A.alert_states(c, 60, 30).orderBy("t").collect()]
    assert got == [(0, "pending", 0), (30, "pending", 0), (60, "firing", 0), (90, "firing", 0), (150, "pending", 150), (180, "pending", 150), (210, "firing", 150)]


def intervals(spark, rows):
    return spark.createDataFrame(rows, "alertname string, severity string, job string, node string, model string, state string, start_t bigint, end_t bigint, value double")


def iv(name, start, end, node="n", job="j", sev="warning", state="firing"):
    return (name, sev, job, node, "", state, start, end, 1.0)


def test_muted_only_while_the_source_fires(spark):
    """Ten hours of load against a minute without telemetry: both outer parts stay."""
    d = intervals(spark, [iv("LoadHigh", 0, 36000), iv("HardwareExporterDown", 10000, 10060), iv("HardwareExporterDown", 10030, 10050),
                          iv("HardwareExporterDown", 500, 600, state="pending"), iv("HardwareExporterDown", 0, 50, node="m")])
    got = sorted((r.start_t, r.end_t, r.value) for r in A.inhibit(d).where("alertname = 'LoadHigh'").collect())
    assert got == [(0, 10000, 1.0), (10060, 36000, 1.0)]


intervals_of = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60), st.integers(0, 40)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(targets=intervals_of, cover=intervals_of, bucket=st.sampled_from([1, 7, 1000]))
def test_subtraction_is_that_of_points(spark, targets, cover, bucket):
    kind = "node string, tag string, start_t bigint, end_t bigint"
    rows = [(k, "x", lo, lo + n) for k, lo, n in targets]
    gone = {(k or "", p) for k, lo, n in cover for p in range(lo, lo + n)}
    want = []
    for k, tag, lo, hi in rows:
        left = [p for p in range(lo, hi) if (k or "", p) not in gone]
        starts = [p for p in left if p - 1 not in left]
        want += [(k or "", tag, p, min(q + 1 for q in left if q >= p and q + 1 not in left)) for p in starts]
    src = A.merge_intervals(spark.createDataFrame([(k or "", "y", lo, lo + n) for k, lo, n in cover], kind), ["node"])
    got = A.subtract_intervals(spark.createDataFrame(rows, kind), src, ["node"], bucket)
    assert sorted((r.node or "", r.tag, r.start_t, r.end_t) for r in got.collect()) == sorted(want)


def test_inhibition_needs_overlap_and_equal_labels(spark):
    d = intervals(spark, [iv("ProxyDown", 100, 200), iv("UpstreamDown", 150, 160), iv("UpstreamDown", 300, 310), iv("ThroughputDrop", 150, 160, job="other"), iv("LoadHigh", 150, 160)])
    left = {(r.alertname, r.start_t, r.job) for r in A.inhibit(d).collect()}
    assert left == {("ProxyDown", 100, "j"), ("UpstreamDown", 300, "j"), ("ThroughputDrop", 150, "other"), ("LoadHigh", 150, "j")}


def test_routing(spark):
    d = intervals(spark, [iv("a", 0, 1, sev="critical"), iv("b", 0, 1)])
    assert {r.alertname: r.receiver for r in A.route_alerts(d).collect()} == {"a": "oncall", "b": "default"}


def test_merge_intervals(spark):
    d = spark.createDataFrame([("k", 0, 10), ("k", 5, 20), ("k", 20, 25), ("k", 40, 50), ("m", 3, 4)], "k string, start_t bigint, end_t bigint")
    assert sorted(tuple(r) for r in A.merge_intervals(d, ["k"]).collect()) == [("k", 0, 25), ("k", 40, 50), ("m", 3, 4)]


def brute_notifications(alerts, wait=30, interval=300, repeat=14400):
    """One group: (start, end) of each alert; flush clock restarts per session."""
    out, todo = [], sorted(alerts)
    while todo:
        session, end = [todo.pop(0)], 0
        end = session[0][1]
        while todo and todo[0][0] <= end + interval:
            session.append(todo.pop(0))
            end = max(end, session[-1][1])
        t, before, last = session[0][0] + wait, None, None
        stop = end + interval + wait
        while t <= stop:
            prev = t - interval if before is not None else -1
            changed = any(prev < s <= t or prev < e <= t for s, e in session)
            firing = sum(s <= t for s, _ in session) - sum(e <= t for _, e in session)
            if changed:
                out.append((t, firing, "resolved" if firing == 0 else "changed"))
                last = t
            elif firing > 0 and (t - last) % (-(-repeat // interval) * interval) == 0:
                out.append((t, firing, "repeat"))
            before, t = firing, t + interval
    return out


@pytest.mark.parametrize("alerts", [[(0, 1000)], [(0, 40000)], [(0, 100), (50, 2000), (900, 950)], [(0, 10), (5000, 6000)]])
def test_notifications(spark, alerts):
    d = intervals(spark, [iv("a", s, e) for s, e in alerts])
    got = sorted((r.t, r.n_firing, r.reason) for r in A.group_notifications(d).collect())
    assert got == sorted(brute_notifications(alerts))


@pytest.mark.parametrize("v,text", [(0.9312, "93.12%"), (1.0, "100%"), (0.5, "50%"), (0.123456, "12.35%"), (0.0, "0%")])
def test_percentages(spark, v, text):
    assert spark.createDataFrame([(v,)], "v double").select(A.humanize_percentage(F.col("v"))).first()[0] == text


def test_annotations(spark):
    d = spark.createDataFrame([("MLXHighErrorRate", "m", "5xx", 0.256)], "alertname string, model string, status string, value double")
    r = A.render_annotations(d, R.templates(DEFAULT_NAMING)).first()
    assert r.summary == "Elevated 5xx error rate for m" and r.description.startswith("Error rate is 0.26 req/s")


def test_flapping(spark):
    rows = [(t, "a", 1.0, 0, s) for t, s in ((0, "firing"), (60, "firing"), (180, "firing"), (300, "pending"), (360, "firing"))]
    d = spark.createDataFrame(rows, "t bigint, alertname string, value double, active_since bigint, state string")
    r = A.flapping_alerts(d, 900, 60).first()
    assert (r.t, r.transitions) == (360, 3)


@pytest.fixture(scope="module")
def source(spark):
    empty = spark.createDataFrame([], "metric string, labels map<string,string>, ts timestamp, value double")
    return Source(empty, S.Grid(0, 600, 60))


def test_catalogue_is_complete(spark):
    assert len(R.CATALOGUE) == len(R.RULES) == 46
    by_group = {}
    for r in R.CATALOGUE:
        by_group[r.group] = by_group.get(r.group, 0) + 1
    assert by_group == {"hardware": 15, "serving": 8, "inference": 7, "quality": 6, "confidence": 5, "slo": 5}
    assert R.rule_catalog(spark).count() == 46


@pytest.mark.parametrize("strict", [False, True])
def test_every_rule_has_a_plan(source, strict):
    for name in R.RULES:
        assert "state" in R.evaluate(source, [name], strict).columns


def test_every_panel_has_a_plan(source):
    for board, panels in DB.PANELS.items():
        for name in panels:
            assert {"t", "value"} <= set(DB.panel(board, name, source, {"model": "m", "node": "n", "tool": "t"}).columns), (board, name)


def test_strict_reading_never_fires_across_labels(spark):
    rows = [("mlx_server_ready", {"job": "mlx-supervisor"}, 1.0), ("mlx_model_loaded", {"job": "mlx-supervisor", "model": "m"}, 0.0)]
    d = spark.createDataFrame(rows, "metric string, labels map<string,string>, value double").withColumn("ts", F.timestamp_seconds(F.lit(60)))
    s = Source(d, S.Grid(0, 600, 60))
    assert R.evaluate(s, ["ModelNotLoaded"]).count() == 5
    assert R.evaluate(s, ["ModelNotLoaded"], strict=True).count() == 0


@pytest.fixture(scope="module")
def busy(spark):
    """Samples of every kind: counters, gauges, buckets, with labels that several rules and panels share."""
    rnd = random.Random(6)
    rows, totals = [], {}
    for t in range(0, 3600, 15):
        at = dt.datetime.fromtimestamp(1_704_067_200 + t, dt.timezone.utc).replace(tzinfo=None)
        for m in ("a", "b"):
            for metric, extra in (("mlx_requests_total", {}), ("mlx_error_total", {"status": "5xx"}), ("mlx_tokens_completion_total", {}), ("mlx_ttft_seconds_bucket", {"le": "10"}),
                                  ("mlx_ttft_seconds_bucket", {"le": "+Inf"}), ("mlx_ttft_seconds_count", {})):
                key = (metric, m, *extra.values())
                totals[key] = totals.get(key, 0) + rnd.randint(0, 9)
                rows.append((metric, {"job": "mlx-proxy", "model": m, **extra}, at, float(totals[key])))
            rows.append(("mlx_hallucination_risk", {"job": "mlx-proxy", "model": m, "kind": "chat"}, at, rnd.random()))
            rows.append(("mlx_heuristic_repetition", {"job": "mlx-proxy", "model": m}, at, rnd.random()))
            rows.append(("mlx_in_flight", {"job": "mlx-proxy", "model": m}, at, float(rnd.randint(0, 12))))
        rows.append(("mlx_hw_load1", {"job": "mlx-hw", "node": "n"}, at, rnd.random() * 16))
        rows.append(("mlx_hw_cpu_count", {"job": "mlx-hw", "node": "n"}, at, 8.0))
    d = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double").repartition(4).cache()
    return Source(d, S.Grid(1_704_067_200, 1_704_067_200 + 3600, 60))


RULED = ["HallucinationRiskElevated", "HighRepetition", "InFlightBacklog", "LoadHigh", "SLOAvailabilityFastBurn", "SLOLatencySlowBurn", "HighErrorRate", "ErrorSpike"]


def test_rules_on_a_shared_roll_up(busy):
    rolled = R.roll_up_for(busy, RULED)
    got, want = (sorted(map(tuple, R.evaluate(s, RULED).collect())) for s in (rolled, busy))
    assert got == want and len(got) > 100
    plan = R.evaluate(rolled, RULED)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "LogicalRDD" not in plan  # the raw samples


def test_each_metric_is_rolled_up_once(busy):
    rolled = R.roll_up_for(busy)
    assert set(rolled.tables) == {"counter", "last", "sum"}
    read = needs(busy, [lambda s, r=r: r.when(s, False) for r in R.CATALOGUE])
    assert len(read) == len({m for _, m in read})  # no metric of two kinds: one scan each


def test_a_board_stacks_its_panels(busy):
    rolled = DB.roll_up_for(busy, ["http"])
    got = DB.board("http", rolled)
    assert got.columns == ["panel", *DB.PANEL_LABELS, "t", "value"]
    per = {r["panel"]: r["n"] for r in got.groupBy("panel").agg(F.count("*").alias("n")).collect()}
    assert per["requests by kind"] > 0 and set(per) <= set(DB.PANELS["http"])
    one = DB.panel("http", "in flight", busy)
    assert sorted((r.t, r.value) for r in got.where("panel = 'in flight'").collect()) == sorted((r.t, r.value) for r in one.collect())
    only = DB.board("http", rolled, {"model": ["a"]}).where("panel = 'prompt cache ratio' or model = 'b'")
    assert only.count() == 0


def test_quantile_panels_take_lists_and_all(busy):
    every, some = (DB.panel("node", "ttft p95", busy, {"node": v}) for v in ("All", ["x", "y"]))
    assert every.count() > 0 and some.count() == 0

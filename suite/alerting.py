"""Alert rules, routing, inhibition and service levels over the derived samples."""

from pyspark.sql import functions as F

from servelens.naming import BOUNDS, DEFAULT_NAMING
from servelens.operators import alerts as A
from servelens.operators import slo as L
from servelens.operators import vector as V
from servelens.plans import rules as R

from .adapters import bucket_increments, call_increments, grid_cte, out, quantile_sql, window_sum
from .registry import query
from .serving import FAST_EV, GRID, source

N = DEFAULT_NAMING
G = grid_cte(GRID)
STEP = GRID.step


def states_sql(cond: str, keys: list[str], hold: int, step: int = STEP) -> str:
    """SQL alert states over a condition query ``(t, keys.., value)``."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    cols = "".join(f"{k}, " for k in keys)
    return f"""SELECT t, {cols}value, active_since, CASE WHEN t - active_since >= {hold} THEN 'firing' ELSE 'pending' END AS state
      FROM (SELECT *, min(t) OVER (PARTITION BY {cols}isl) AS active_since FROM (
        SELECT *, sum(brk) OVER ({part}ORDER BY t) AS isl FROM (
          SELECT *, CASE WHEN lag(t) OVER ({part}ORDER BY t) = t - {step} THEN 0 ELSE 1 END AS brk FROM ({cond}))))"""


def rule_sql(ctes: str, cond: str, keys: list[str], hold: int) -> str:
    cols = "".join(f"{k}, " for k in keys)
    return f"WITH {FAST_EV}, {G}{', ' + ctes if ctes else ''} SELECT t, {cols}round(value, 6) AS value, active_since, state FROM ({states_sql(cond, keys, hold)})"


def states(spark, sf, name, keys):
    d = R.evaluate(source(spark, sf), [name])
    return out(d.select("t", *keys, "value", "active_since", "state"))


ERR = call_increments("er0", ["model", "status", "kind"], "k", "status >= 400").replace("er0 AS", "err AS")
REQ = call_increments("req", ["model", "streaming", "kind", "node"], "200")
TOK = call_increments("tok", ["model", "kind"], "k")
ERR_RATE = "SELECT t, model, CASE WHEN status >= 500 THEN '5xx' ELSE '4xx' END AS status, value / 300.0 AS value FROM (" + window_sum("err", 300, ["model", "status"]) + ")"


@query("alert_high_error_rate", rule_sql(ERR, f"SELECT * FROM ({ERR_RATE}) WHERE value > 0.2", ["model", "status"], 300))
def alert_high_error_rate(spark, sf):
    return states(spark, sf, "HighErrorRate", ["model", "status"])


@query("alert_error_spike", rule_sql(
    ERR + f", a AS ({window_sum('err', 300, ['model'])}), b AS ({window_sum('err', 900, ['model'], shift=1800)})",
    "SELECT t, model, a.value / 300.0 AS value FROM a JOIN b USING (t, model) WHERE a.value / 300.0 > 3 * (b.value / 900.0 + 0.01)",
    ["model"], 600))
def alert_error_spike(spark, sf):
    return states(spark, sf, "ErrorSpike", ["model"])


@query("alert_high_ttft_p95", rule_sql(
    bucket_increments("bk", "ttft", BOUNDS["ttft_seconds"], ["model"])
    + f", v AS ({window_sum('bk', 300, ['model', 'le', 'bound'])})",
    f"SELECT * FROM ({quantile_sql(0.95, 'v', ['model'])}) WHERE value > 5", ["model"], 300))
def alert_high_ttft_p95(spark, sf):
    return states(spark, sf, "HighTTFTP95", ["model"])


@query("alert_throughput_drop", rule_sql(
    TOK + f", a AS ({window_sum('tok', 300, ['model'])}), b AS ({window_sum('tok', 1800, ['model'], shift=600)})",
    "SELECT t, model, a.value / 300.0 AS value FROM a JOIN b USING (t, model) WHERE b.value / 1800.0 > 1 "
    "AND a.value / 300.0 < 0.7 * (b.value / 1800.0 + 1e-9)", ["model"], 300))
def alert_throughput_drop(spark, sf):
    s = source(spark, sf)
    base = s.offset(600, lambda x: x.rate("tokens_completion_total", 1800, ["model"]))
    low = L.baseline_compare(s.rate("tokens_completion_total", 300, ["model"]), base, "<", 0.7, 1e-9, ["model"])
    return out(A.alert_states(V.vec_and(low, V.cmp(base, ">", 1), on=["model"]), 300, STEP))


LAST_RISK = """SELECT g.t AS t, i.model, i.kind, arg_max(i.k / 100, i.us) AS value FROM grid g JOIN ev i
       ON i.us > (g.t - 300) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL"""


@query("alert_hallucination_risk", rule_sql(
    REQ + f", r AS ({window_sum('req', 600, ['model'])})",
    f"SELECT v.* FROM ({LAST_RISK}) v JOIN r USING (t, model) WHERE v.value > 0.5 AND r.value > 0", ["model", "kind"], 300))
def alert_hallucination_risk(spark, sf):
    return states(spark, sf, "HallucinationRiskElevated", ["model", "kind"])


@query("alert_high_repetition", rule_sql(
    REQ + f", r AS ({window_sum('req', 600, ['model'])}), m AS ({window_sum('ev', 600, ['model'], 'avg(least(i.value / 97, 1))')})",
    "SELECT m.* FROM m JOIN r USING (t, model) WHERE m.value > 0.3 AND r.value > 0", ["model"], 300))
def alert_high_repetition(spark, sf):
    return states(spark, sf, "HighRepetition", ["model"])


@query("alert_load_high", rule_sql("", """SELECT t, node, value FROM (SELECT g.t AS t, i.node, arg_max(i.value / 20, i.us) AS value
       FROM grid g JOIN ev i ON i.us > (g.t - 300) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL) WHERE value > 8""", ["node"], 600))
def alert_load_high(spark, sf):
    return states(spark, sf, "LoadHigh", ["node"])


@query("alert_power_spike", rule_sql(
    """p AS (SELECT g.t AS t, i.node, arg_max(i.value * 100, i.us) AS value FROM grid g JOIN ev i
       ON i.us > (g.t - 300) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL),
       q AS (SELECT g.t AS t, i.node, arg_max(i.value * 100, i.us) AS value FROM grid g JOIN ev i
       ON i.us > (g.t - 420) * 1000000 AND i.us <= (g.t - 120) * 1000000 GROUP BY ALL)""",
    "SELECT t, node, p.value - q.value AS value FROM p JOIN q USING (t, node) WHERE p.value - q.value > 15000", ["node"], 60))
def alert_power_spike(spark, sf):
    return states(spark, sf, "PowerSpike", ["node"])


@query("alert_slo_slow_burn", rule_sql(
    call_increments("e5", ["model", "kind"], "k", "status >= 500") + ", " + REQ
    + f", a AS ({window_sum('e5', 21600, [])}), b AS ({window_sum('req', 21600, [])})",
    "SELECT t, (a.value / 21600.0) / greatest(b.value / 21600.0, 0.0001) / 0.005 AS value FROM a JOIN b USING (t) "
    "WHERE (a.value / 21600.0) / greatest(b.value / 21600.0, 0.0001) / 0.005 > 3 AND b.value > 0", [], 900))
def alert_slo_slow_burn(spark, sf):
    return states(spark, sf, "SLOAvailabilitySlowBurn", [])


@query("alert_latency_slow_burn", rule_sql(
    bucket_increments("bk", "ttft", BOUNDS["ttft_seconds"], ["model"])
    + f", a AS ({window_sum('bk', 21600, ['le'])})",
    "SELECT x.t, (1 - greatest(x.value / greatest(y.value / 21600.0, 0.0001) / 21600.0, 0)) / 0.05 AS value FROM a x JOIN a y ON x.t = y.t "
    "AND x.le = '10' AND y.le = '+Inf' WHERE (1 - greatest(x.value / greatest(y.value / 21600.0, 0.0001) / 21600.0, 0)) / 0.05 > 3", [], 900))
def alert_latency_slow_burn(spark, sf):
    return states(spark, sf, "SLOLatencySlowBurn", [])


@query("alert_budget_exhausted", rule_sql(
    call_increments("e5", ["model", "kind"], "k", "status >= 500") + ", " + REQ
    + f", a AS ({window_sum('e5', 2592000, [])}), b AS ({window_sum('req', 2592000, [])})",
    "SELECT t, a.value / greatest(b.value, 0.0001) / 0.005 AS value FROM a JOIN b USING (t) "
    "WHERE a.value / greatest(b.value, 0.0001) / 0.005 >= 1 AND b.value > 0", [], 300))
def alert_budget_exhausted(spark, sf):
    return states(spark, sf, "ErrorBudgetExhausted", [])


BASE_STATES = f"st AS ({states_sql(f'SELECT * FROM ({ERR_RATE}) WHERE value > 0.2', ['model', 'status'], 300)})"


@query("alert_annotations", f"""WITH {FAST_EV}, {G}, {ERR}, {BASE_STATES}
       SELECT t, model, status, 'Elevated ' || status || ' error rate for ' || model AS summary,
       'Error rate is ' || printf('%.2f', value) || ' req/s for the last 5 minutes.' AS description FROM st WHERE state = 'firing'""")
def alert_annotations(spark, sf):
    d = R.evaluate(source(spark, sf), ["HighErrorRate"]).where("state = 'firing'")
    return A.render_annotations(d, {N.a("HighErrorRate"): R.templates(N)[N.a("HighErrorRate")]}).select(
        "t", "model", "status", "summary", "description")


@query("alert_active_by_severity", f"""WITH {FAST_EV}, {G}, {ERR}, {BASE_STATES}
       SELECT t, 'warning' AS severity, count(*)::DOUBLE AS value FROM st WHERE state = 'firing' GROUP BY t""")
def alert_active_by_severity(spark, sf):
    return A.active_alerts(R.evaluate(source(spark, sf), ["HighErrorRate"]), ["severity"])


INTERVALS = f"""iv AS (SELECT model, status, state, min(t) AS start_t, max(t) + {STEP} AS end_t FROM st GROUP BY model, status, state, active_since)"""


@query("alert_intervals", f"""WITH {FAST_EV}, {G}, {ERR}, {BASE_STATES}, {INTERVALS} SELECT model, status, state, start_t, end_t FROM iv""")
def alert_intervals(spark, sf):
    d = A.alert_intervals(R.evaluate(source(spark, sf), ["HighErrorRate"]), STEP)
    return d.select("model", "status", "state", "start_t", "end_t")


def two_rules(spark, sf):
    """Down targets and load alerts per node as intervals, for routing and inhibition."""
    return A.alert_intervals(R.evaluate(source(spark, sf), ["HardwareExporterDown", "LoadHigh"]), STEP)


def node_rule_sql(alert: str, severity: str, value: str, test: str, hold: int) -> str:
    cond = (f"SELECT t, node, value FROM (SELECT g.t AS t, i.node, arg_max({value}, i.us) AS value FROM grid g JOIN ev i "
            f"ON i.us > (g.t - 300) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL) WHERE value {test}")
    return (f"SELECT '{alert}' AS alertname, '{severity}' AS severity, node, state, min(t) AS start_t, max(t) + {STEP} AS end_t "
            f"FROM ({states_sql(cond, ['node'], hold)}) GROUP BY node, state, active_since")


TWO = (f"iv AS ({node_rule_sql(N.a('HardwareExporterDown'), 'critical', 'CASE WHEN i.k > 5 THEN 1 ELSE 0 END', '= 0', 120)} UNION ALL "
       f"{node_rule_sql(N.a('LoadHigh'), 'warning', 'i.value / 20', '> 8', 600)})")


@query("alert_routing", f"""WITH {FAST_EV}, {G}, {TWO} SELECT alertname, CASE WHEN severity = 'critical' THEN 'oncall' ELSE 'default' END
       AS receiver, state, count(*) AS n FROM iv GROUP BY ALL""")
def alert_routing(spark, sf):
    return A.route_alerts(two_rules(spark, sf)).groupBy("alertname", "receiver", "state").agg(F.count(F.lit(1)).alias("n"))


@query("alert_inhibition", f"""WITH {FAST_EV}, {G}, {TWO}, pts AS (
       SELECT alertname, node, state, start_t AS was, unnest(range(start_t, end_t, {STEP})) AS p FROM iv),
       down AS (SELECT DISTINCT node, p FROM pts WHERE alertname = '{N.a('HardwareExporterDown')}' AND state = 'firing'),
       loud AS (SELECT *, p - {STEP} * row_number() OVER (PARTITION BY alertname, node, state, was ORDER BY p) AS run FROM pts a
                WHERE alertname <> '{N.a('LoadHigh')}' OR NOT EXISTS (SELECT 1 FROM down d WHERE d.node = a.node AND d.p = a.p))
       SELECT alertname, node, state, min(p) AS start_t, max(p) + {STEP} AS end_t FROM loud GROUP BY alertname, node, state, was, run""")
def alert_inhibition(spark, sf):
    return A.inhibit(two_rules(spark, sf), prefix=N.alert).select("alertname", "node", "state", "start_t", "end_t")


LOAD = node_rule_sql(N.a("LoadHigh"), "warning", "i.value / 20", "> 8", 600)
KEYS = "alertname, node, model"
NOTIFIED = f"""WITH {FAST_EV}, {G}, {ERR}, {BASE_STATES}, fire AS (
       SELECT '{N.a('HighErrorRate')}' AS alertname, '' AS node, model, min(t) AS s, max(t) + {STEP} AS e FROM st WHERE state = 'firing' GROUP BY model, status, active_since
       UNION ALL SELECT alertname, node, '', start_t, end_t FROM ({LOAD}) WHERE state = 'firing'),
       opened AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {KEYS} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300 THEN NULL ELSE s END AS o FROM fire),
       ses AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS session FROM opened),
       flush AS (SELECT {KEYS}, session, unnest(range(session + 30, last + 331, 300)) AS t FROM (SELECT {KEYS}, session, max(e) AS last FROM ses GROUP BY ALL)),
       seen AS (SELECT f.alertname, f.node, f.model, f.session, f.t, count(*) FILTER (x.s <= f.t) - count(*) FILTER (x.e <= f.t) AS n_firing,
         count(*) FILTER (x.e <= f.t AND (x.e > f.t - 300 OR f.t = f.session + 30)) AS n_resolved,
         count(*) FILTER (x.s <= f.t AND (x.s > f.t - 300 OR f.t = f.session + 30)) AS n_new
         FROM flush f JOIN ses x ON x.alertname = f.alertname AND x.node = f.node AND x.model = f.model AND x.session = f.session GROUP BY ALL),
       told AS (SELECT *, n_new + n_resolved > 0 AS changed, max(CASE WHEN n_new + n_resolved > 0 THEN t END) OVER (PARTITION BY {KEYS}, session ORDER BY t) AS since FROM seen)
       SELECT {KEYS}, t::BIGINT AS t, n_firing::BIGINT AS n_firing, n_resolved::BIGINT AS n_resolved,
       CASE WHEN changed AND n_firing = 0 THEN 'resolved' WHEN changed THEN 'changed' ELSE 'repeat' END AS reason
       FROM told WHERE changed OR n_firing > 0 AND (t - since) % 14400 = 0"""


@query("alert_notifications", NOTIFIED)
def alert_notifications(spark, sf):
    d = A.alert_intervals(R.evaluate(source(spark, sf), ["HighErrorRate", "LoadHigh"]), STEP)
    return A.group_notifications(d)


@query("alert_flapping", f"""WITH {FAST_EV}, {G}, {ERR}, {BASE_STATES}, rise AS (
       SELECT t FROM (SELECT *, lag(t) OVER w AS pt, lag(state) OVER w AS ps FROM st WINDOW w AS (PARTITION BY model, status ORDER BY t))
       WHERE state = 'firing' AND NOT coalesce(ps = 'firing' AND pt = t - {STEP}, FALSE)),
       c AS (SELECT a.t, (SELECT count(*) FROM rise b WHERE b.t > a.t - 3600 AND b.t <= a.t) AS n FROM rise a)
       SELECT '{N.a('HighErrorRate')}' AS alertname, min(t) AS t, max(n) AS transitions FROM c WHERE n = (SELECT max(n) FROM c)""")
def alert_flapping(spark, sf):
    return A.flapping_alerts(R.evaluate(source(spark, sf), ["HighErrorRate"]), 3600, STEP)


E5_REQ = call_increments("e5", ["model", "kind"], "k", "status >= 500") + ", " + REQ


def sli_sql(expr: str) -> str:
    return (f"WITH {FAST_EV}, {G}, {E5_REQ}, a AS ({window_sum('e5', 43200, [])}), b AS ({window_sum('req', 43200, [])}), "
            f"v AS (SELECT t, a.value / greatest(b.value, 1) AS bad FROM a JOIN b USING (t)) "
            f"SELECT g.t AS t, round(CASE WHEN bad IS NULL THEN 100 ELSE {expr} END, 6) AS value FROM grid g LEFT JOIN v ON v.t = g.t")


def _errors(s):
    return s.counter("error_total", (), {"status": "5xx"})


@query("slo_availability_sli", sli_sql("100 * greatest(1 - bad, 0)"))
def slo_availability_sli(spark, sf):
    s = source(spark, sf)
    return out(L.availability_sli(_errors(s), s.counter("requests_total"), 43200, GRID))


@query("slo_availability_budget", sli_sql("100 * greatest(1 - bad / 0.005, 0)"))
def slo_availability_budget(spark, sf):
    s = source(spark, sf)
    return out(L.availability_budget_left(_errors(s), s.counter("requests_total"), 43200, GRID))


def latency_sql(expr: str) -> str:
    return (f"WITH {FAST_EV}, {G}, {bucket_increments('bk', 'ttft', BOUNDS['ttft_seconds'], ['model'])}, "
            f"a AS ({window_sum('bk', 43200, ['le'])}), v AS (SELECT x.t, greatest(x.value / greatest(y.value, 1), 0) AS good "
            f"FROM a x JOIN a y ON x.t = y.t AND x.le = '10' AND y.le = '+Inf') "
            f"SELECT g.t AS t, round(CASE WHEN good IS NULL THEN 100 ELSE {expr} END, 6) AS value FROM grid g LEFT JOIN v ON v.t = g.t")


@query("slo_latency_sli", latency_sql("100 * good"))
def slo_latency_sli(spark, sf):
    s = source(spark, sf)
    return out(L.latency_sli(s.counter("ttft_seconds_bucket", (), {"le": "10"}), s.counter("ttft_seconds_count"), 43200, GRID))


@query("slo_latency_budget", latency_sql("100 * greatest(1 - (1 - good) / 0.05, 0)"))
def slo_latency_budget(spark, sf):
    s = source(spark, sf)
    return out(L.latency_budget_left(s.counter("ttft_seconds_bucket", (), {"le": "10"}), s.counter("ttft_seconds_count"), 43200, GRID))


def burn_sql(name: str, w: int) -> str:
    return (f"SELECT t, '{name}' AS \"window\", (a.value / {w}.0) / greatest(b.value / {w}.0, 0.0001) / 0.005 AS burn, b.value / {w}.0 AS traffic "
            f"FROM ({window_sum('e5', w, [])}) a JOIN ({window_sum('req', w, [])}) b USING (t)")


@query("slo_burn_rates", f"""WITH {FAST_EV}, {G}, {E5_REQ} SELECT t, "window", round(burn, 6) AS burn, round(traffic, 6) AS traffic
       FROM ({burn_sql('5m', 300)} UNION ALL {burn_sql('1h', 3600)} UNION ALL {burn_sql('6h', 21600)})""")
def slo_burn_rates(spark, sf):
    s = source(spark, sf)
    return out(L.burn_rates(_errors(s), s.counter("requests_total"), {"5m": 300, "1h": 3600, "6h": 21600}, GRID, 0.005))


@query("slo_burn_alerts", f"""WITH {FAST_EV}, {G}, {E5_REQ} SELECT t, "window", round(burn, 6) AS value
       FROM ({burn_sql('1h', 3600)} UNION ALL {burn_sql('6h', 21600)}) WHERE traffic > 0
       AND burn > CASE "window" WHEN '1h' THEN 4.0 ELSE 3.0 END""")
def slo_burn_alerts(spark, sf):
    s = source(spark, sf)
    b = L.burn_rates(_errors(s), s.counter("requests_total"), {"1h": 3600, "6h": 21600}, GRID, 0.005)
    return out(L.burn_alerts(b, {"1h": 4.0, "6h": 3.0}))

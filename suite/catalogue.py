"""The whole alert catalogue on shared roll-ups, against SQL that states every rule anew."""

from servelens.naming import BOUNDS, DEFAULT_NAMING
from servelens.plans import rules as R

from .adapters import bucket_increments, call_increments, grid_cte, out, quantile_sql, window_sum
from .alerting import ERR, ERR_RATE, REQ, TOK, states_sql
from .registry import query
from .serving import FAST_EV, GRID, source

N = DEFAULT_NAMING
PROXY, HW, SUP, TAILER = (N.j(x) for x in ("proxy", "hw", "supervisor", "logtailer"))
LABELS = R.ALERT_LABELS


def last(expr: str, labels: tuple[str, ...] = (), where: str = "TRUE", ago: int = 0) -> str:
    """Instant value of a gauge with one sample per event."""
    cols = "".join(f"i.{c} AS {c}, " for c in labels)
    return (f"SELECT g.t AS t, {cols}arg_max({expr}, i.us) AS value FROM grid g JOIN ev i ON i.us > (g.t - {300 + ago}) * 1000000 "
            f"AND i.us <= (g.t - {ago}) * 1000000 WHERE {where} GROUP BY ALL")


def mean(expr: str, window: int) -> str:
    return window_sum("ev", window, ["model"], f"avg({expr})")


def above(inner: str, test: str, fixed: str = "") -> str:
    return f"SELECT *{', ' + fixed if fixed else ''} FROM ({inner}) WHERE value {test}"


def gated(inner: str, test: str, gate: str, fixed: str = "") -> str:
    return f"SELECT v.*{', ' + fixed if fixed else ''} FROM ({inner}) v JOIN {gate} r USING (t, model) WHERE v.value {test} AND r.value > 0"


def job(name: str) -> str:
    return f"'{name}' AS job"


def down(own: str, test: str) -> str:
    """``up`` of a job: a sample per event and node, 0 unless the test holds."""
    return above(last(f"CASE WHEN {test} THEN 1 ELSE 0 END", ("node",)), "= 0", f"node AS instance, {job(own)}")


def burn(kind: str, w: int, limit: float) -> str:
    if kind == "availability":
        v = f"SELECT t, (a.value / {w}.0) / greatest(b.value / {w}.0, 0.0001) / 0.005 AS value, b.value AS traffic FROM ({window_sum('e5', w, [])}) a JOIN ({window_sum('req', w, [])}) b USING (t)"
    else:
        v = (f"SELECT x.t, (1 - greatest((x.value / {w}.0) / greatest(y.value / {w}.0, 0.0001), 0)) / 0.05 AS value, b.value AS traffic "
             f"FROM (SELECT * FROM ({window_sum('bk', w, ['le'])}) WHERE le = '10') x JOIN (SELECT * FROM ({window_sum('bk', w, ['le'])}) WHERE le = '+Inf') y ON x.t = y.t "
             f"JOIN ({window_sum('req', w, [])}) b ON b.t = x.t")
    return f"SELECT t, value FROM ({v}) WHERE value > {limit} AND traffic > 0"


CTES = ", ".join([
    ERR, REQ, TOK, call_increments("e5", ["model", "kind"], "k", "status >= 500"), call_increments("restart", [], "1", "event_type = 'error' AND k > 90"),
    call_increments("shipped", ["severity"], "1", "k < 30").replace("FROM ev ", "FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 'error' ELSE 'info' END AS severity FROM ev) "),
    call_increments("probe", ["result"], "1").replace("FROM ev ", "FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'fail' END AS result FROM ev) "),
    call_increments("scored", ["model", "source"], "1", "model <> 'm2'").replace("FROM ev ", "FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'injected' ELSE 'client' END AS source FROM ev) "),
    bucket_increments("bk", "ttft", BOUNDS["ttft_seconds"], ["model"]), bucket_increments("bg", "gen", BOUNDS["generation_seconds"], ["model"]),
    f"ttft_v AS ({window_sum('bk', 300, ['model', 'le', 'bound'])})", f"gen_v AS ({window_sum('bg', 300, ['model', 'le', 'bound'])})",
    f"req10 AS ({window_sum('req', 600, ['model'])})", f"req30 AS ({window_sum('req', 1800, ['model'])})",
    f"scored10 AS ({window_sum('scored', 600, ['model'])})", f"scored15 AS ({window_sum('scored', 900, ['model'])})", f"scored30 AS ({window_sum('scored', 1800, ['model'])})",
    f"probes AS ({window_sum('probe', 600, ['result'])})"])

THERMAL = "CASE WHEN i.k > 60 THEN i.k / 100 ELSE 0 END"
#: Condition and hold time of every rule, said directly over the events.
CONDITIONS = {
    "GPUHighUtilization": (above(last("least(i.value / 4, 100)", ("node",)), "> 95"), 300),
    "GPUMemoryPressure": (above(last("greatest(least(i.value / 490, 1) * 16e9 / 16e9, 0)", ("node",)), "> 0.9"), 120),
    "HighPackagePower": (above(last("i.value * 100", ("node",)), "> 30000"), 300),
    "PowerSpike": (f"SELECT t, node, p.value - q.value AS value FROM ({last('i.value * 100', ('node',))}) p JOIN ({last('i.value * 100', ('node',), ago=120)}) q USING (t, node) "
                   "WHERE p.value - q.value > 15000", 60),
    "ThermalThrottling": (above(last(THERMAL, ("node",)), "> 0"), 300),
    "CriticalThermalPressure": (above(last(THERMAL, ("node",)), "> 0.6"), 180),
    "MemoryPressureHigh": (above(last("i.value * 100", ("node",)), "< 20000"), 600),
    "LoadHigh": (above(last("i.value / 20", ("node",)), "> 8"), 600),
    "DiskNearlyFull": (above(last("i.value * 1e9 / 500e9", ("node",)), "> 0.9"), 300),
    "HardwareExporterDown": (down(HW, "i.k > 5"), 120),
    "ProxyDown": (down(PROXY, "i.k > 5"), 120),
    "UpstreamDown": (above(last("CASE WHEN i.k > 3 THEN 1 ELSE 0 END"), "= 0", job(PROXY)), 60),
    "VictoriaMetricsDown": (down("victoria-metrics", "i.k > 16"), 120),
    "VmalertDown": (down("vmalert", "i.k > 7"), 120),
    "AlertmanagerDown": (down("alertmanager", "i.k > 12"), 120),
    "ServerDown": (above(last("CASE WHEN i.k > 4 THEN 1 ELSE 0 END"), "= 0", job(SUP)), 60),
    "ModelNotLoaded": (f"SELECT *, {job(SUP)} FROM ({last('CASE WHEN i.k > 20 THEN 1 ELSE 0 END')}) WHERE value = 1 AND t IN "
                       f"(SELECT t FROM ({last('CASE WHEN i.k > 30 THEN 1 ELSE 0 END', ('model',))}) WHERE value = 0)", 120),
    "ServerCrashLoop": (above(window_sum("restart", 900, []), "> 3", job(SUP)), 120),
    "ServerRepeatedCrashes": (above(window_sum("restart", 3600, []), "> 5", job(SUP)), 120),
    "ServerReadyProbeFailing": (f"SELECT f.t AS t, f.value AS value, {job(SUP)} FROM probes f JOIN probes o ON f.t = o.t AND f.result = 'fail' AND o.result = 'ok' WHERE f.value > 6 * (o.value + 0.01)", 300),
    "ServerMetalFault": (above(last("CASE WHEN i.k > 50 THEN 1 ELSE 0 END", (), "i.k % 2 = 0"), "= 1", "'metal_gpu_error' AS reason"), 60),
    "LogTailerDown": (above(last("CASE WHEN i.k > 2 THEN 1 ELSE 0 END"), "= 0", job(TAILER)), 120),
    "LogTailerNotSending": (f"SELECT *, {job(TAILER)} FROM ({window_sum('shipped', 900, ['severity'])}) WHERE value = 0 AND t IN "
                            f"(SELECT t FROM ({last('CASE WHEN i.k > 2 THEN 1 ELSE 0 END')}) WHERE value = 1)", 300),
    "HighErrorRate": (above(ERR_RATE, "> 0.2"), 300),
    "ErrorSpike": (f"SELECT t, model, a.value / 300.0 AS value FROM ({window_sum('err', 300, ['model'])}) a JOIN ({window_sum('err', 900, ['model'], shift=1800)}) b USING (t, model) "
                   "WHERE a.value / 300.0 > 3 * (b.value / 900.0 + 0.01)", 600),
    "HighTTFTP95": (above(quantile_sql(0.95, "ttft_v", ["model"]), "> 5"), 300),
    "SlowGenerationP95": (above(quantile_sql(0.95, "gen_v", ["model"]), "> 30"), 300),
    "InferenceStalled": (f"SELECT t, value / 300.0 AS value FROM ({window_sum('tok', 300, [])}) WHERE value = 0 AND t IN "
                         f"(SELECT t FROM (SELECT t, sum(value) AS busy FROM ({last('i.k % 12', ('model',))}) GROUP BY t) WHERE busy > 0)", 120),
    "InFlightBacklog": (above(last("i.k % 12", ("model",)), "> 8"), 120),
    "ThroughputDrop": (f"SELECT t, model, a.value / 300.0 AS value FROM ({window_sum('tok', 300, ['model'])}) a JOIN ({window_sum('tok', 1800, ['model'], shift=600)}) b USING (t, model) "
                       "WHERE b.value / 1800.0 > 5 AND a.value / 300.0 < 0.1 * (b.value / 1800.0 + 1e-9)", 900),
    "HallucinationRiskElevated": (gated(last("i.k / 100", ("model", "kind")), "> 0.5", "req10", job(PROXY)), 300),
    "HallucinationRiskCritical": (gated(last("i.k / 100", ("model", "kind")), "> 0.8", "req10", job(PROXY)), 120),
    "HighRepetition": (gated(mean("least(i.value / 97, 1)", 600), "> 0.3", "req10", job(PROXY)), 300),
    "HighRefusalRate": (gated(mean("CASE WHEN i.k < 30 THEN 1 ELSE 0 END", 600), "> 0.5", "req10", job(PROXY)), 600),
    "HighHedging": (gated(mean("i.k / 200", 600), "> 0.3", "req10", job(PROXY)), 600),
    "HighUngrounded": (gated(mean("i.k / 300", 600), "> 0.3", "req10", job(PROXY)), 600),
    "LowTokenConfidence": (gated(mean("1 - i.k / 128", 900), "< 0.5", "scored15", job(PROXY)), 600),
    "HighPerplexity": (gated(mean("1 + i.value / 40", 900), "> 8", "scored15", job(PROXY)), 600),
    "HighTokenEntropy": (gated(mean("i.value / 300", 900), "> 1.5", "scored15", job(PROXY)), 600),
    "ConfidenceCollapse": (gated(mean("i.cents / 131072", 600), "< 0.15", "scored10", job(PROXY)), 600),
    "ConfidenceScoringStopped": ("SELECT s.t AS t, model, s.value / 1800.0 AS value FROM scored30 s JOIN req30 r USING (t, model) WHERE s.value = 0 AND r.value > 0", 1800),
    "SLOAvailabilityFastBurn": (burn("availability", 3600, 14.4), 300),
    "SLOAvailabilitySlowBurn": (burn("availability", 21600, 3.0), 900),
    "SLOLatencyFastBurn": (burn("latency", 3600, 14.4), 300),
    "SLOLatencySlowBurn": (burn("latency", 21600, 3.0), 900),
    "ErrorBudgetExhausted": (f"SELECT t, a.value / greatest(b.value, 0.0001) / 0.005 AS value FROM ({window_sum('e5', 2592000, [])}) a JOIN ({window_sum('req', 2592000, [])}) b USING (t) "
                             "WHERE a.value / greatest(b.value, 0.0001) / 0.005 >= 1 AND b.value > 0", 300),
}
def _keys(name: str) -> list[str]:
    """Labels that tell a rule's series apart, by which hold times run."""
    own = {"HighErrorRate": ["model", "status"], "HallucinationRiskElevated": ["model", "kind"], "HallucinationRiskCritical": ["model", "kind"], "LogTailerNotSending": ["severity"]}
    if name in own:
        return own[name]
    rule = R.RULES[name]
    by_node = rule.group == "hardware" and name != "UpstreamDown"
    by_model = rule.group in ("quality", "confidence") or name in ("ErrorSpike", "HighTTFTP95", "SlowGenerationP95", "InFlightBacklog", "ThroughputDrop")
    return ["node"] if by_node else ["model"] if by_model else []


def _fixed(cond: str) -> list[str]:
    """Labels with one value, which the condition's text carries along."""
    return [c for c in ("job", "instance", "reason") if f" AS {c}" in cond]


def rule_states(name: str) -> str:
    cond, hold = CONDITIONS[name]
    rule, keys = R.RULES[name], [*_keys(name), *_fixed(cond)]
    cols = ", ".join(c if c in keys else f"'' AS {c}" for c in LABELS)
    inner = states_sql(f"SELECT t, {''.join(c + ', ' for c in keys)}value FROM ({cond})", keys, hold)
    return f"SELECT '{N.a(name)}' AS alertname, '{rule.severity}' AS severity, '{rule.category}' AS category, {cols}, t, round(value, 6) AS value, active_since, state FROM ({inner})"


@query("alert_catalogue_states", f"WITH {FAST_EV}, {grid_cte(GRID)}, {CTES} " + " UNION ALL ".join(f"({rule_states(n)})" for n in R.RULES))
def alert_catalogue_states(spark, sf):
    """All 46 rules at shipped thresholds over the whole samples table; each metric is rolled up once."""
    return out(R.evaluate(R.roll_up_for(source(spark, sf))))

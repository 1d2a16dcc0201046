"""The alert catalogue: every rule as data plus a condition over a ``Source``.

Conditions use the intended match key of each rule (``on=``).  Under
``strict=True`` the rules whose two sides carry different labels are matched on
all labels, under which they can never fire.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slo as L
from ..operators import vector as V
from ..operators.alerts import alert_states
from .rollups import RolledUp, needs, roll_up
from .source import Source

MIN, HOUR, DAY = 60, 3600, 86400


@dataclass(frozen=True)
class Rule:
    name: str
    group: str
    hold: int
    severity: str
    category: str
    when: Callable[[Source, bool], DataFrame]
    summary: str
    description: str


GROUP_INTERVAL = {"hardware": 30, "serving": 15, "inference": 15, "quality": 30, "confidence": 30, "slo": 30}


def _above(metric, op, x, labels=("node",), eq=None, raw=False):
    return lambda s, strict: V.cmp(s.last(metric, labels, eq, raw=raw), op, x)


def _down(job):
    def when(s, strict):
        return V.cmp(s.last("up", ["job", "instance", "node"], {"job": s.naming.j(job) if job in OWN_JOBS else job}, raw=True),
                     "==", 0)
    return when


def _own(metric, op, x, job, labels=("node", "job"), eq=None):
    return lambda s, strict: V.cmp(s.last(metric, labels, {**(eq or {}), "job": s.naming.j(job)}), op, x)


def _proxy(s):
    return {"job": s.naming.j("proxy")}


OWN_JOBS = ("hw", "proxy", "kv", "supervisor", "logtailer")


def _memory_pressure(s, strict):
    total = s.last("hw_gpu_mem_total_bytes", ["node"])
    used = V.clamp_min(V.arith(s.last("hw_gpu_mem_alloc_bytes", ["node"]), "/", total), 0)
    return V.vec_and(V.cmp(used, ">", 0.9), V.cmp(total, ">", 0), on=["node"])


def _power_spike(s, strict):
    def power(x):
        return x.last("hw_package_power_milliwatts", ["node"])
    return V.cmp(V.arith(power(s), "-", s.offset(2 * MIN, power)), ">", 15000)


def _load_high(s, strict):
    return V.cmp(s.last("hw_load1", ["node"]), ">", s.last("hw_cpu_count", ["node"]))


def _disk_full(s, strict):
    return V.cmp(V.arith(s.last("hw_disk_used_bytes", ["node"]), "/", s.last("hw_disk_total_bytes", ["node"])), ">", 0.9)


def _model_not_loaded(s, strict):
    job = {"job": s.naming.j("supervisor")}
    ready = V.cmp(s.last("server_ready", ["job"], job), "==", 1)
    missing = V.cmp(s.last("model_loaded", ["job", "model"], job), "==", 0)
    return V.vec_and(ready, missing, on=None if strict else [])


def _restarts(window, limit):
    def when(s, strict):
        return V.cmp(s.increase("server_restarts_total", window, ["job"], {"job": s.naming.j("supervisor")}), ">", limit)
    return when


def _probe_failing(s, strict):
    job = s.naming.j("supervisor")

    def checks(result):
        return s.increase("server_health_checks_total", 10 * MIN, ["job", "result"], {"job": job, "result": result})
    limit = V.scalar(V.scalar(checks("ok"), "+", 0.01), "*", 6)
    return V.cmp(checks("fail"), ">", limit, on=None if strict else ["job"])


def _not_sending(s, strict):
    job = {"job": s.naming.j("logtailer")}
    idle = V.cmp(s.increase("log_tailer_shipped_total", 15 * MIN, ["job", "severity"], job), "==", 0)
    return V.vec_and(idle, V.cmp(s.last("log_tailer_up", ["job"], job), "==", 1), on=[])


def _error_rate(s, strict):
    return V.cmp(s.rate("error_total", 5 * MIN, ["model", "status"], _proxy(s)), ">", 0.2)


def _error_spike(s, strict):
    base = s.offset(30 * MIN, lambda x: x.rate("error_total", 15 * MIN, ["model"], _proxy(x)))
    return L.baseline_compare(s.rate("error_total", 5 * MIN, ["model"], _proxy(s)), base, ">", 3, 0.01, ["model"])


def _slow(metric, limit):
    return lambda s, strict: V.cmp(s.quantile(0.95, metric, 5 * MIN, ["model"], _proxy(s)), ">", limit)


def _stalled(s, strict):
    idle = V.cmp(s.rate("tokens_completion_total", 5 * MIN, (), _proxy(s)), "==", 0)
    return V.vec_and(idle, V.cmp(V.agg_by(s.last("in_flight", ["model"]), "sum"), ">", 0), on=[])


def _throughput_drop(s, strict):
    base = s.offset(10 * MIN, lambda x: x.rate("tokens_completion_total", 30 * MIN, ["model"], _proxy(x)))
    now = s.rate("tokens_completion_total", 5 * MIN, ["model"], _proxy(s))
    return V.vec_and(L.baseline_compare(now, base, "<", 0.1, 1e-9, ["model"]), V.cmp(base, ">", 5), on=["model"])


def _quality(metric, op, x, window=None, traffic="requests_total", span=10 * MIN):
    """A quality gauge, gated by traffic of the same model."""
    def when(s, strict):
        labels = ["model", "kind", "job", "node"] if window is None else ["model", "job", "node"]
        v = s.last(metric, labels) if window is None else s.mean(metric, window, labels)
        gate = s.rate(traffic, span, ["model"], _proxy(s) if traffic == "requests_total" else None)
        return V.vec_and(V.cmp(v, op, x), V.cmp(gate, ">", 0), on=None if strict else ["model"])
    return when


def _scoring_stopped(s, strict):
    idle = V.cmp(s.rate("confidence_scored_total", 30 * MIN, ["model"]), "==", 0)
    return V.vec_and(idle, V.cmp(s.rate("requests_total", 30 * MIN, ["model"], _proxy(s)), ">", 0))


def _burn(kind, speed):
    label, window, limit = speed

    def when(s, strict):
        p = _proxy(s)
        requests = s.counter("requests_total", (), p)
        if kind == "availability":
            burns = L.burn_rates(s.counter("error_total", (), {**p, "status": "5xx"}), requests, {label: window}, s.grid,
                                 L.AVAILABILITY_BUDGET)
            v = L.burn_alerts(burns, {label: limit}).drop("window")
        else:
            burns = L.burn_rates(s.counter("ttft_seconds_bucket", (), {**p, "le": L.LATENCY_BOUND}),
                                 s.counter("ttft_seconds_count", (), p), {label: window}, s.grid, L.LATENCY_BUDGET,
                                 invert=True)
            v = V.cmp(burns.select("t", F.col("burn").alias("value")), ">", limit)
            v = L.traffic_gate(v, s.rate("requests_total", window, (), p), on=[])
        return v
    return when


def _exhausted(s, strict):
    p = _proxy(s)
    return L.budget_exhausted(s.counter("error_total", (), {**p, "status": "5xx"}), s.counter("requests_total", (), p),
                              30 * DAY, s.grid)


# Names, hold times, severities, categories and thresholds of the shipped rules.  The texts are short forms of our own.
CATALOGUE = (
    Rule("GPUHighUtilization", "hardware", 5 * MIN, "warning", "gpu", _above("hw_gpu_utilization_percent", ">", 95),
         "GPU residency sustained above 95% on {node}", "GPU active residency is {value:%.1f}% for over 5 minutes. Heavy load or a stuck process."),
    Rule("GPUMemoryPressure", "hardware", 2 * MIN, "critical", "gpu", _memory_pressure,
         "GPU (unified) memory nearly exhausted on {node}", "GPU memory allocation is {value:pct} of the unified pool. Model OOMs are likely."),
    Rule("HighPackagePower", "hardware", 5 * MIN, "warning", "power", _above("hw_package_power_milliwatts", ">", 30000),
         "Sustained high package power on {node}", "Combined CPU+GPU+ANE power is {value:%.0f} mW for over 5 minutes."),
    Rule("PowerSpike", "hardware", 1 * MIN, "info", "power", _power_spike,
         "Package power spike on {node}", "Package power jumped by {value:%.0f} mW in 2 minutes."),
    Rule("ThermalThrottling", "hardware", 5 * MIN, "warning", "thermal", _above("hw_thermal_pressure", ">", 0),
         "Thermal throttling active on {node}", "pmset -g therm reports a non-zero CPU scheduler limit (pressure {value:%.2f})."),
    Rule("CriticalThermalPressure", "hardware", 3 * MIN, "critical", "thermal", _above("hw_thermal_pressure", ">", 0.6),
         "Critical thermal pressure on {node}", "Thermal pressure is {value:%.2f}: heavy scheduler throttling in effect."),
    Rule("MemoryPressureHigh", "hardware", 10 * MIN, "warning", "memory", _above("hw_mem_pressure", "<", 20000),
         "Low free pages on {node}", "vm.page_free_count is {value:%.0f}: the system is under memory pressure."),
    Rule("LoadHigh", "hardware", 10 * MIN, "warning", "cpu", _load_high,
         "Sustained high load on {node}", "1-minute load average {value:%.2f} exceeds the logical CPUs."),
    Rule("DiskNearlyFull", "hardware", 5 * MIN, "warning", "storage", _disk_full,
         "Root volume nearly full on {node}", "Disk usage is {value:pct}."),
    Rule("HardwareExporterDown", "hardware", 2 * MIN, "critical", "availability", _down("hw"),
         "Hardware telemetry agent down on {instance}", "The hardware agent on {node} has not been scraped for 2 minutes."),
    Rule("ProxyDown", "hardware", 2 * MIN, "critical", "availability", _down("proxy"),
         "Metrics proxy down", "The metrics proxy on {instance} has not been scraped for 2 minutes."),
    Rule("UpstreamDown", "hardware", 1 * MIN, "critical", "availability", _own("up", "==", 0, "proxy"),
         "Upstream server unreachable", "The proxy cannot reach its upstream backend."),
    Rule("VictoriaMetricsDown", "hardware", 2 * MIN, "critical", "availability", _down("victoria-metrics"),
         "VictoriaMetrics is down", "The metrics database is not responding to scrapes."),
    Rule("VmalertDown", "hardware", 2 * MIN, "critical", "availability", _down("vmalert"),
         "vmalert is down", "Alert evaluation has stopped; this alert may be stale."),
    Rule("AlertmanagerDown", "hardware", 2 * MIN, "warning", "availability", _down("alertmanager"),
         "Alertmanager is down", "Fired alerts are not being routed to notifications."),
    Rule("ServerDown", "serving", 1 * MIN, "critical", "availability", _own("server_up", "==", 0, "supervisor"),
         "Server process is down", "The supervisor reports the server process down."),
    Rule("ModelNotLoaded", "serving", 2 * MIN, "warning", "availability", _model_not_loaded,
         "Server process up but model not being served", "The model has not been reported as loaded for 2 minutes."),
    Rule("ServerCrashLoop", "serving", 2 * MIN, "critical", "availability", _restarts(15 * MIN, 3),
         "Server crash loop", "More than 3 restarts in 15 minutes (reason: {reason})."),
    Rule("ServerRepeatedCrashes", "serving", 2 * MIN, "critical", "availability", _restarts(HOUR, 5),
         "Server crashing repeatedly over the last hour", "{value:%.0f} restarts in the last hour."),
    Rule("ServerReadyProbeFailing", "serving", 5 * MIN, "warning", "availability", _probe_failing,
         "Serving health probe mostly failing", "Health-probe failures dominate the last 10 minutes."),
    Rule("ServerMetalFault", "serving", 1 * MIN, "critical", "gpu",
         _above("server_last_crash_reason", "==", 1, ("node", "reason"), {"reason": "metal_gpu_error"}),
         "Server crashed with a Metal GPU fault", "A Metal command-buffer / GPU error killed the server."),
    Rule("LogTailerDown", "serving", 2 * MIN, "warning", "observability", _own("log_tailer_up", "==", 0, "logtailer"),
         "Log tailer is down", "No server log lines are being shipped."),
    Rule("LogTailerNotSending", "serving", 5 * MIN, "warning", "observability", _not_sending,
         "Log tailer up but nothing shipped", "The tailer is healthy but has not shipped a log line in 15 minutes."),
    Rule("HighErrorRate", "inference", 5 * MIN, "warning", "inference", _error_rate,
         "Elevated {status} error rate for {model}", "Error rate is {value:%.2f} req/s for the last 5 minutes."),
    Rule("ErrorSpike", "inference", 10 * MIN, "warning", "inference", _error_spike,
         "Error spike for {model}", "Errors jumped 3x above the 30-minute-ago baseline."),
    Rule("HighTTFTP95", "inference", 5 * MIN, "warning", "latency", _slow("ttft_seconds", 5),
         "High time-to-first-token for {model}", "P95 TTFT is {value:%.2f}s over the last 5 minutes."),
    Rule("SlowGenerationP95", "inference", 5 * MIN, "warning", "latency", _slow("generation_seconds", 30),
         "Slow generation for {model}", "P95 generation time is {value:%.2f}s over the last 5 minutes."),
    Rule("InferenceStalled", "inference", 2 * MIN, "critical", "inference", _stalled,
         "Inference stalled while requests are in flight", "No completion tokens have been produced for 2 minutes."),
    Rule("InFlightBacklog", "inference", 2 * MIN, "warning", "inference", _above("in_flight", ">", 8, ("model",)),
         "Request backlog on the proxy", "More than 8 requests are in flight concurrently."),
    Rule("ThroughputDrop", "inference", 15 * MIN, "warning", "throughput", _throughput_drop,
         "Throughput collapse for {model}", "Completion-token rate dropped below 10% of its 30-minute baseline."),
    Rule("HallucinationRiskElevated", "quality", 5 * MIN, "warning", "hallucination", _quality("hallucination_risk", ">", 0.5),
         "Elevated hallucination risk for {model}", "Composite heuristic risk is {value:%.2f} for the last 5 minutes."),
    Rule("HallucinationRiskCritical", "quality", 2 * MIN, "critical", "hallucination", _quality("hallucination_risk", ">", 0.8),
         "Critical hallucination risk for {model}", "Composite heuristic risk is {value:%.2f}: outputs should be reviewed."),
    Rule("HighRepetition", "quality", 5 * MIN, "warning", "hallucination", _quality("heuristic_repetition", ">", 0.3, 10 * MIN),
         "High repetition for {model}", "Most-repeated word-trigram ratio averaged {value:%.2f} over 10 minutes."),
    Rule("HighRefusalRate", "quality", 10 * MIN, "info", "hallucination", _quality("heuristic_refusal", ">", 0.5, 10 * MIN),
         "High refusal rate for {model}", "Refusal pattern present in more than half of recent outputs."),
    Rule("HighHedging", "quality", 10 * MIN, "warning", "hallucination", _quality("heuristic_hedging", ">", 0.3, 10 * MIN),
         "High hedge-word density for {model}", "Normalized hedge density averaged {value:%.2f} over 10 minutes."),
    Rule("HighUngrounded", "quality", 10 * MIN, "warning", "hallucination", _quality("heuristic_ungrounded", ">", 0.3, 10 * MIN),
         "Possible ungrounded content for {model}", "Ungrounded/unsupported claims heuristic averaged {value:%.2f} over 10 minutes."),
    Rule("LowTokenConfidence", "confidence", 10 * MIN, "warning", "confidence",
         _quality("token_confidence_mean", "<", 0.5, 15 * MIN, "confidence_scored_total", 15 * MIN),
         "Low token confidence for {model}", "Mean sampled-token probability averaged {value:%.2f} over 15 minutes."),
    Rule("HighPerplexity", "confidence", 10 * MIN, "warning", "confidence",
         _quality("output_perplexity", ">", 8, 15 * MIN, "confidence_scored_total", 15 * MIN),
         "High output perplexity for {model}", "Perplexity averaged {value:%.1f} over 15 minutes."),
    Rule("HighTokenEntropy", "confidence", 10 * MIN, "warning", "confidence",
         _quality("token_entropy_nats", ">", 1.5, 15 * MIN, "confidence_scored_total", 15 * MIN),
         "High token entropy for {model}", "Mean per-token entropy averaged {value:%.2f} nats over 15 minutes."),
    Rule("ConfidenceCollapse", "confidence", 10 * MIN, "critical", "confidence",
         _quality("token_margin_mean", "<", 0.15, 10 * MIN, "confidence_scored_total", 10 * MIN),
         "Token margin collapsed for {model}", "The gap between the top-1 and top-2 candidates averaged {value:%.2f}."),
    Rule("ConfidenceScoringStopped", "confidence", 30 * MIN, "info", "confidence", _scoring_stopped,
         "No completions scored for {model}", "Traffic is flowing but nothing has been scored for 30 minutes."),
    Rule("SLOAvailabilityFastBurn", "slo", 5 * MIN, "critical", "slo", _burn("availability", L.FAST_BURN),
         "Availability SLO (99.5%) fast burn", "5xx burn rate is {value:%.1f}x the allowed 0.5% budget over the last hour."),
    Rule("SLOAvailabilitySlowBurn", "slo", 15 * MIN, "warning", "slo", _burn("availability", L.SLOW_BURN),
         "Availability SLO (99.5%) slow burn", "5xx burn rate is {value:%.1f}x the allowed 0.5% budget over 6 hours."),
    Rule("SLOLatencyFastBurn", "slo", 5 * MIN, "critical", "slo", _burn("latency", L.FAST_BURN),
         "Latency SLO (p95 TTFT <= 10s) fast burn", "Share of slow first tokens is {value:%.1f}x the allowed 5% budget over the last hour."),
    Rule("SLOLatencySlowBurn", "slo", 15 * MIN, "warning", "slo", _burn("latency", L.SLOW_BURN),
         "Latency SLO (p95 TTFT <= 10s) slow burn", "Share of slow first tokens is {value:%.1f}x the allowed 5% budget over 6 hours."),
    Rule("ErrorBudgetExhausted", "slo", 5 * MIN, "critical", "slo", _exhausted,
         "Availability error budget exhausted for the window", "The 30-day 5xx error budget is fully consumed (burn rate {value:%.2f})."),
)
RULES = {r.name: r for r in CATALOGUE}
ALERT_LABELS = ("job", "instance", "node", "model", "kind", "status", "reason")


def rule_catalog(spark) -> DataFrame:
    """The catalogue as rows."""
    rows = [(r.name, r.group, GROUP_INTERVAL[r.group], r.hold, r.severity, r.category) for r in CATALOGUE]
    return spark.createDataFrame(rows, "name string, rule_group string, interval int, hold int, severity string, category string")


def roll_up_for(source: Source, names: Iterable[str] | None = None) -> RolledUp:
    """Each metric that the chosen rules read, reduced once; :func:`evaluate` on the result scans no raw samples."""
    return roll_up(source, needs(source, [lambda s, r=RULES[n]: r.when(s, False) for n in (names or RULES)]))


def evaluate(source: Source, names: Iterable[str] | None = None, strict: bool = False) -> DataFrame:
    """States of the chosen rules in one frame: ``(alertname, severity, category, labels.., t, value, active_since, state)``.

    The source grid is the evaluation schedule.  Each rule reads only its own
    metrics, so on a partitioned samples table each branch prunes to them.  For
    many rules, evaluate on :func:`roll_up_for`: rules then share roll-ups.
    """
    parts = []
    for name in names or RULES:
        r = RULES[name]
        states = alert_states(r.when(source, strict), r.hold, source.grid.step)
        have = set(states.columns)
        parts.append(states.select(
            F.lit(source.naming.a(name)).alias("alertname"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"),
            *[(F.col(c) if c in have else F.lit("")).alias(c) for c in ALERT_LABELS], "t", "value", "active_since", "state"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def templates(naming) -> dict[str, tuple[str, str]]:
    """Annotation templates by full alert name, for ``render_annotations``."""
    return {naming.a(r.name): (r.summary, r.description) for r in CATALOGUE}

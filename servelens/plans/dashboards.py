"""Every dashboard panel as a function of a ``Source``.

Panels that differ only in metric, labels, window or scale share one builder, so
the boards are data.  ``PANELS[board][panel]`` takes ``(source, variables)``;
variables become regex matchers (:func:`samples.bind_variables`).
"""

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import samples as S
from ..operators import slo as L
from ..operators import vector as V
from ..operators.histograms import bucket_fraction
from .rollups import RolledUp, needs, roll_up
from .source import Source

MIN, HOUR, DAY = 60, 3600, 86400
Panel = Callable[[Source, dict], DataFrame]


def _pick(variables: dict, names) -> dict | None:
    """Matchers for the variables a panel uses; an unset variable matches everything."""
    bound = S.bind_variables({n: variables.get(n) for n in names})
    return {n: v for n, v in bound.items() if v != ".*"} or None


def gauge(metric: str, labels=(), eq=None, use=(), scale: float | None = None) -> Panel:
    """A bare selector, optionally divided by a unit."""
    def panel(s, v):
        d = s.last(metric, labels, eq, _pick(v, use))
        return d if scale is None else V.scalar(d, "/", scale)
    return panel


def total(metric: str, by=(), fn="sum", use=(), scale: float | None = None, times: float | None = None) -> Panel:
    """``fn by (labels)`` of a gauge."""
    def panel(s, v):
        d = V.agg_by(s.last(metric, by, None, _pick(v, use)), fn, list(by))
        if scale is not None:
            d = V.scalar(d, "/", scale)
        return d if times is None else V.scalar(d, "*", times)
    return panel


def percent(part: str, whole: str, labels=("node",), use=("node",)) -> Panel:
    """100 * gauge / gauge with equal labels."""
    def panel(s, v):
        m = _pick(v, use)
        return V.scalar(V.arith(s.last(part, labels, None, m), "/", s.last(whole, labels, None, m)), "*", 100)
    return panel


def flow(metric: str, by=(), window: int = 5 * MIN, times: float | None = 60, use=("model",), eq=None) -> Panel:
    """``sum(rate(metric[window])) by (labels) * times``."""
    def panel(s, v):
        d = s.rate(metric, window, by, eq, _pick(v, use))
        return d if times is None else V.scalar(d, "*", times)
    return panel


def grown(metric: str, window: int, by=(), use=("model",), eq=None, re=None, ranked: bool = False) -> Panel:
    """``sum(increase(metric[window])) by (labels)``."""
    def panel(s, v):
        d = s.increase(metric, window, by, eq, {**(re or {}), **(_pick(v, use) or {})})
        return V.sort_desc(d) if ranked else d
    return panel


def ratio(top: str, bottom: str, by=(), window: int = 5 * MIN, times: float = 1.0, floor: float = 0.0001, top_eq=None,
          use=("model",), rates: bool = True) -> Panel:
    """``times * sum(top) by / clamp_min(sum(bottom) by, floor)``."""
    def panel(s, v):
        m = _pick(v, use)
        read = s.rate if rates else s.increase
        d = V.arith(read(top, window, by, top_eq, m), "/", V.clamp_min(read(bottom, window, by, None, m), floor))
        return d if times == 1.0 else V.scalar(d, "*", times)
    return panel


def quantile(q: float, metric: str, window: int = 30 * MIN, eq=None, use=()) -> Panel:
    def panel(s, v):
        return s.quantile(q, metric, window, (), eq, _pick(v, use))
    return panel


def _distinct(window: int) -> Panel:
    def panel(s, v):
        return V.count_by(grown("tool_calls_total", window, ["tool"], re={"tool": ".+"})(s, v))
    return panel


def _tool_share(window: int) -> Panel:
    def panel(s, v):
        return V.sort_desc(V.share_of_total(grown("tool_calls_total", window, ["tool"], re={"tool": ".+"})(s, v), 1.0))
    return panel


def _ring_errors(s, v):
    both = ["node", "iface"]
    rx, tx = s.rate("net_rx_errors_total", 5 * MIN, both), s.rate("net_tx_errors_total", 5 * MIN, both)
    return V.agg_by(V.arith(rx, "+", tx), "sum", ["node"])


def _kv_at_max(s, v):
    m = _pick(v, ("model",))
    return V.arith(s.last("kv_bytes_per_token", ["model"], None, m), "*", s.last("context_length_max_tokens", ["model"], None, m))


def _last_reason(s, v):
    return V.cmp(s.last("server_last_crash_reason", ["reason"]), "==", 1)


def _up(job: str | None = None) -> Panel:
    def panel(s, v):
        eq = {"job": s.naming.j(job)} if job else None
        return s.last("up", ["job", "node"], eq, _pick(v, ("node",)), raw=True)
    return panel


def _nodes_online(s, v):
    return V.count_by(V.cmp(_up("hw")(s, {}), "==", 1))


def _sli(fn, window: int = 30 * DAY) -> Panel:
    def panel(s, v):
        if "latency" in fn.__name__:
            return fn(s.counter("ttft_seconds_bucket", (), {"le": L.LATENCY_BOUND}), s.counter("ttft_seconds_count"), window, s.grid)
        return fn(s.counter("error_total", (), {"status": "5xx"}), s.counter("requests_total"), window, s.grid)
    return panel


def _availability_burn(s, v):
    return L.burn_rates(s.counter("error_total", (), {"status": "5xx"}), s.counter("requests_total"), {"5m": 5 * MIN}, s.grid,
                        L.AVAILABILITY_BUDGET).selectExpr("t", "burn AS value")


def _latency_burn(s, v):
    good = bucket_fraction(s.rate("ttft_seconds_bucket", 5 * MIN, (), {"le": L.LATENCY_BOUND}), s.rate("ttft_seconds_count", 5 * MIN), 0.0001, on=[])
    return V.scalar(V.scalar(V.clamp_min(good, 0), "-", 1, swap=True), "/", L.LATENCY_BUDGET)


def _fact(attr: str) -> Panel:
    return gauge("model_info", ["model", "attr"], {"attr": attr}, ("model",))


_GIB = 1073741824.0
_NODE, _MODEL = ("node",), ("model",)
_FACTS = ("layer_count", "attention_heads", "kv_heads", "head_dim", "hidden_size", "linear_key_heads", "linear_value_heads",
          "linear_key_head_dim", "linear_value_head_dim", "linear_conv_kernel_dim", "mtp_layers", "quant_bits",
          "quant_group_size", "vocab_size", "intermediate_size")


def _node_gauge(metric: str, scale: float | None = None) -> Panel:
    return gauge(metric, _NODE, None, _NODE, scale)


def _model_gauge(metric: str, labels=_MODEL) -> Panel:
    return gauge(metric, labels, None, _MODEL)


# Panels of each board.
PANELS: dict[str, dict[str, Panel]] = {
    "call-types": {
        "requests by kind": flow("requests_total", ["kind"]),
        "reasoning share %": ratio("requests_total", "requests_total", times=100, top_eq={"kind": "reasoning"}),
        "stream vs sync": flow("requests_total", ["kind", "streaming"]),
        "prompt tokens": flow("tokens_prompt_total", ["kind"], times=None),
        "completion tokens": flow("tokens_completion_total", ["kind"], times=None),
        "tool calls by kind": flow("tool_calls_total", ["kind"]),
        "finish reason by kind": flow("finish_reason_total", ["reason", "kind"]),
        "tool calls by tool": flow("tool_calls_total", ["tool"]),
        "tool calls by type": flow("tool_calls_total", ["type"]),
        "avg prompt tokens": ratio("tokens_prompt_total", "requests_total", ["kind"]),
        "avg completion tokens": ratio("tokens_completion_total", "requests_total", ["kind"]),
        "error ratio %": ratio("error_total", "requests_total", ["kind"], times=100),
        "temperature": _model_gauge("temperature", ["model", "kind"]),
        "hallucination risk": _model_gauge("hallucination_risk", ["model", "kind"]),
        "hallucination flags": flow("hallucination_flag_total"),
        "reasoning share 24h": ratio("requests_total", "requests_total", window=DAY, times=100, floor=1, top_eq={"kind": "reasoning"}, rates=False)},
    "gpu-power": {
        "gpu utilization": _node_gauge("hw_gpu_utilization_percent"), "gpu iokit utilization": _node_gauge("hw_gpu_iokit_util_percent"),
        "gpu frequency": _node_gauge("hw_gpu_frequency_mhz"), "gpu memory used": _node_gauge("hw_gpu_mem_used_bytes", _GIB),
        "gpu memory alloc": _node_gauge("hw_gpu_mem_alloc_bytes", _GIB), "gpu memory %": percent("hw_gpu_mem_used_bytes", "hw_gpu_mem_total_bytes"),
        "gpu power": _node_gauge("hw_gpu_power_milliwatts", 1000), "cpu power": _node_gauge("hw_cpu_power_milliwatts", 1000),
        "ane power": _node_gauge("hw_ane_power_milliwatts", 1000), "package power": _node_gauge("hw_package_power_milliwatts", 1000),
        "thermal pressure": _node_gauge("hw_thermal_pressure"), "nodes online": _nodes_online,
        "gpu memory total": total("hw_gpu_mem_used_bytes", use=_NODE, scale=_GIB)},
    "http": {
        "requests by streaming": flow("requests_total", ["streaming"]), "requests by kind": flow("requests_total", ["kind"]),
        "in flight": total("in_flight", use=_MODEL), "requests 24h": grown("requests_total", DAY),
        "errors by status": flow("error_total", ["status"]), "errors by kind": flow("error_total", ["kind"]),
        "error ratio %": ratio("error_total", "requests_total", times=100), "upstream reachable": total("up", fn="min"),
        **{f"ttft p{int(q * 100)}": quantile(q, "ttft_seconds") for q in (0.5, 0.95, 0.99)},
        **{f"generation p{int(q * 100)}": quantile(q, "generation_seconds") for q in (0.5, 0.95)},
        **{f"token rate p{int(q * 100)}": quantile(q, "token_rate_tokens_per_second") for q in (0.5, 0.95)},
        "prompt tokens": flow("tokens_prompt_total", times=None), "completion tokens": flow("tokens_completion_total", times=None),
        "avg tokens per request": ratio("tokens_prompt_total", "requests_total", window=10 * MIN),
        "tool calls": flow("tool_calls_total"), "hallucination flags": flow("hallucination_flag_total"),
        "tool calls by tool": flow("tool_calls_total", ["tool"]), "finish reason": flow("finish_reason_total", ["reason"]),
        "temperature": _model_gauge("temperature", ["model", "kind"]), "context used": _model_gauge("context_used_tokens"),
        "context utilization": _model_gauge("context_utilization"), "prompt cache ratio": _model_gauge("prompt_cache_ratio"),
        "cumulative cache hit %": ratio("prompt_cached_tokens_total", "tokens_prompt_total", window=10 * MIN, times=100, floor=1, rates=False),
        "cached tokens": flow("prompt_cached_tokens_total"),
        **{f"queue wait p{int(q * 100)}": quantile(q, "queue_wait_seconds") for q in (0.5, 0.95)},
        "low confidence responses": flow("low_confidence_response_total")},
    "logs": {
        "lines by severity": flow("log_tailer_lines_total", ["severity"], use=()), "lines by category": flow("log_tailer_lines_total", ["category"], use=()),
        "shipped": flow("log_tailer_shipped_total", use=()), "dropped by reason": flow("log_tailer_dropped_total", ["reason"], use=()),
        "tailer errors": flow("log_tailer_errors_total", use=()), "queue depth": gauge("log_tailer_queue_depth"), "file bytes": gauge("log_tailer_file_bytes"),
        "tailer up": gauge("log_tailer_up"), "worker cpu": total("worker_cpu_percent", _NODE), "worker rss": total("worker_rss_bytes", _NODE),
        "server state": gauge("server_state")},
    "model-internals": {
        "architecture": _model_gauge("model_arch", ["model", "arch", "dtype"]), **{a.replace("_", " "): _fact(a) for a in _FACTS},
        "worker rss": total("worker_rss_bytes", _NODE), "gpu memory used": total("hw_gpu_mem_used_bytes", _NODE),
        "gpu utilization": total("hw_gpu_utilization_percent", _NODE), "ring rx": flow("net_rx_bytes_total", _NODE, times=None, use=()),
        "ring tx": flow("net_tx_bytes_total", _NODE, times=None, use=()), "ring errors": _ring_errors,
        "kv bytes by type": total("kv_cache_bytes", ["type"]), "kv utilization": gauge("kv_cache_utilization"),
        "kv sequences by type": total("kv_cache_sequences", ["type"]), "kv bytes per token": gauge("kv_bytes_per_token"),
        "kv bytes at max context": gauge("kv_est_bytes_max_context"), "max sequences": gauge("kv_cache_max_sequences"),
        "max context": _model_gauge("context_length_max_tokens"), "context used": _model_gauge("context_used_tokens"),
        "context utilization": _model_gauge("context_utilization"), "kv bytes per token (model)": _model_gauge("kv_bytes_per_token")},
    "model": {
        **{a.replace("_", " "): _fact(a) for a in _FACTS if not a.startswith(("linear", "mtp"))},
        "architecture": _model_gauge("model_arch", ["model", "arch", "dtype"]), "max context": _model_gauge("context_length_max_tokens"),
        "kv bytes per token": _model_gauge("kv_bytes_per_token"), "kv at max context": _kv_at_max,
        "context utilization %": total("context_utilization", fn="max", use=_MODEL, times=100), "context used": _model_gauge("context_used_tokens"),
        "context utilization": _model_gauge("context_utilization"), "server uptime": gauge("server_uptime_seconds"),
        "restarts": lambda s, v: V.agg_by(s.last("server_restarts_total"), "sum"), "last crash reason": _last_reason,
        "scoring coverage %": ratio("confidence_scored_total", "requests_total", window=30 * MIN, times=100, use=())},
    "node": {
        **{m: _node_gauge(f"hw_{m}") for m in ("load1", "load5", "load15", "gpu_frequency_mhz", "gpu_utilization_percent", "gpu_power_milliwatts",
                                               "package_power_milliwatts", "thermal_pressure", "mem_used_bytes", "mem_total_bytes", "mem_pressure",
                                               "cpu_count", "uptime_seconds", "up")},
        "memory used %": percent("hw_mem_used_bytes", "hw_mem_total_bytes"), "worker rss": _node_gauge("worker_rss_bytes"),
        "worker cpu": _node_gauge("worker_cpu_percent"), "gpu memory used %": percent("hw_gpu_mem_used_bytes", "hw_gpu_mem_total_bytes"),
        "gpu memory used": _node_gauge("hw_gpu_mem_used_bytes", _GIB), "gpu memory alloc": _node_gauge("hw_gpu_mem_alloc_bytes", _GIB),
        "cpu power": _node_gauge("hw_cpu_power_milliwatts", 1000), "ane power": _node_gauge("hw_ane_power_milliwatts", 1000),
        "disk used %": percent("hw_disk_used_bytes", "hw_disk_total_bytes"), "requests": flow("requests_total", ["model"], MIN, use=_NODE),
        **{f"ttft p{int(q * 100)}": quantile(q, "ttft_seconds", 5 * MIN, use=_NODE) for q in (0.5, 0.95)},
        **{f"token rate p{int(q * 100)}": quantile(q, "token_rate_tokens_per_second", 5 * MIN, use=_NODE) for q in (0.5, 0.95)},
        "in flight": _model_gauge("in_flight"), "errors": flow("error_total", ["status"], MIN, None, ()), "telemetry up": _up()},
    "sre": {
        "availability sli": _sli(L.availability_sli), "availability budget left": _sli(L.availability_budget_left),
        "latency sli": _sli(L.latency_sli), "latency budget left": _sli(L.latency_budget_left),
        "requests 30d": grown("requests_total", 30 * DAY, use=()), "5xx 30d": grown("error_total", 30 * DAY, use=(), eq={"status": "5xx"}),
        "4xx 30d": grown("error_total", 30 * DAY, use=(), eq={"status": "4xx"}), "serving uptime": gauge("server_uptime_seconds"),
        "5xx ratio %": ratio("error_total", "requests_total", times=100, top_eq={"status": "5xx"}, use=()), "ttft p95": quantile(0.95, "ttft_seconds"),
        "availability burn": _availability_burn, "latency burn": _latency_burn},
    "tools": {
        "tool calls": grown("tool_calls_total", 30 * DAY, re={"tool": ".+"}), "distinct tools": _distinct(30 * DAY), "tools active 7d": _distinct(7 * DAY),
        "tools active 24h": _distinct(DAY), "tool calls by tool": flow("tool_calls_total", ["tool"], use=("model", "tool")),
        "tool calls by type": flow("tool_calls_total", ["type"], use=("model", "tool")),
        "all tools": grown("tool_calls_total", 30 * DAY, ["tool", "type"], re={"tool": ".+"}, ranked=True),
        "tool calls 24h": grown("tool_calls_total", DAY, ["tool"], re={"tool": ".+"}, ranked=True), "share of calls": _tool_share(30 * DAY),
        "tool calls by kind": flow("tool_calls_total", ["kind"], use=("model", "tool"))},
}


def panel(board: str, name: str, source: Source, variables: dict | None = None) -> DataFrame:
    """One panel as a vector."""
    return PANELS[board][name](source, variables or {})


def roll_up_for(source: Source, boards: Iterable[str] | None = None) -> RolledUp:
    """Each metric that the panels of some boards read, reduced once; panels on the result scan no raw samples."""
    return roll_up(source, needs(source, [lambda s, p=p: p(s, {}) for b in (boards or PANELS) for p in PANELS[b].values()]))


#: Labels that any panel shows.
PANEL_LABELS = ("kind", "streaming", "reason", "tool", "type", "model", "node", "status", "severity", "category", "attr", "arch", "dtype", "job")


def board(name: str, source: Source, variables: dict | None = None) -> DataFrame:
    """All panels of a board stacked: ``(panel, labels.., t, value)``, labels that a panel lacks being ''.

    On a source of :func:`roll_up_for` the panels share one roll-up per metric.
    """
    parts = []
    for title, read in PANELS[name].items():
        d = read(source, variables or {})
        parts.append(d.select(F.lit(title).alias("panel"), *[(F.col(c) if c in d.columns else F.lit("")).alias(c) for c in PANEL_LABELS], "t", "value"))
    return reduce(DataFrame.unionByName, parts)


def heatmap(source: Source, metric: str = "hw_gpu_utilization_percent", step: int = 60, bins: int = 24, node: str | None = None) -> DataFrame:
    """Value heat map of a node gauge."""
    d = source._series(metric, ["node"], {"node": node} if node else None, None, False)
    return V.value_heatmap(d, step, bins, ["node"])


def variable_values(source: Source, metric: str, label: str, eq: dict | None = None, re: dict | None = None) -> DataFrame:
    """Values offered by a dashboard variable."""
    return S.label_values(source.samples, source.naming.m(metric), label, eq, re)


def firing_overlay(states: DataFrame) -> DataFrame:
    """Firing alerts as annotations."""
    return states.where("state = 'firing'").select("t", "alertname", "severity", "node", "model")


def firing_count(states: DataFrame, source: Source, node: str | None = None) -> DataFrame:
    """``count(firing) or vector(0)``."""
    d = states if node is None else states.where(states["node"] == node)
    return V.vec_or(source.firing(d), V.constant(states.sparkSession, source.grid, 0.0), on=[])

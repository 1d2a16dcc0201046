"""Every dashboard panel, one stacked query per board, against SQL that states each panel anew over the events."""

from servelens.naming import BOUNDS, DEFAULT_NAMING
from servelens.plans import dashboards as DB

from .adapters import bucket_increments, call_increments, grid_cte, out, quantile_sql, window_sum
from .registry import query
from .serving import FAST_EV, GRID, source

N = DEFAULT_NAMING
MIN, HOUR, DAY = 60, 3600, 86400
GIB = 1073741824.0

EX = """ex AS MATERIALIZED (SELECT * EXCLUDE (status), (status // 100)::VARCHAR || 'xx' AS status, status AS code, 't' || (k % 5) AS tool, 'function' AS type,
  CASE WHEN k % 3 = 0 THEN 'length' ELSE 'stop' END AS reason, CASE WHEN k % 2 = 0 THEN 'injected' ELSE 'client' END AS source,
  CASE WHEN k % 3 = 0 THEN 'error' ELSE 'info' END AS severity, event_type AS category, 'en0' AS iface, ['total', 'user', 'assistant', 'system'][k % 4 + 1] AS ktype,
  CASE WHEN k % 2 = 0 THEN 'metal_gpu_error' ELSE 'oom' END AS crash, k / greatest(gen, 0.1) AS rate, ttft / 10 AS wait FROM ev)"""

#: Counters: labels, amount per event, condition.
COUNTERS = {
    "requests_total": ("model streaming kind node", "200", "TRUE"), "tokens_prompt_total": ("model kind", "k * 3", "TRUE"), "tokens_completion_total": ("model kind", "k", "TRUE"),
    "tool_calls_total": ("model kind tool type", "1", "k % 2 = 0"), "finish_reason_total": ("model reason kind", "1", "TRUE"), "hallucination_flag_total": ("model", "1", "k > 80"),
    "error_total": ("model status kind", "k", "code >= 400"), "prompt_cached_tokens_total": ("model kind", "k", "TRUE"), "confidence_scored_total": ("model source", "1", "model <> 'm2'"),
    "low_confidence_response_total": ("model", "1", "k < 10"), "log_tailer_lines_total": ("severity category", "1", "TRUE"), "log_tailer_shipped_total": ("severity", "1", "k < 30"),
    "log_tailer_dropped_total": ("reason", "1", "TRUE"), "log_tailer_errors_total": ("", "1", "k = 7"), "net_rx_bytes_total": ("node iface", "k * 1000", "TRUE"),
    "net_tx_bytes_total": ("node iface", "k * 900", "TRUE"), "net_rx_errors_total": ("node iface", "1", "k = 3"), "net_tx_errors_total": ("node iface", "1", "k = 4")}
HISTOGRAMS = {"ttft_seconds": "ttft", "generation_seconds": "gen", "token_rate_tokens_per_second": "rate", "queue_wait_seconds": "wait"}

#: Gauges: value of an event's sample.
NODE_GAUGES = {
    "gpu_utilization_percent": "least(i.value / 4, 100)", "gpu_iokit_util_percent": "i.k", "gpu_frequency_mhz": "i.k * 12", "gpu_mem_used_bytes": "i.k * 1e8",
    "gpu_mem_alloc_bytes": "least(i.value / 490, 1) * 16e9", "gpu_mem_total_bytes": "16e9", "gpu_power_milliwatts": "i.k * 100", "cpu_power_milliwatts": "i.k * 80",
    "ane_power_milliwatts": "i.k * 5", "package_power_milliwatts": "i.value * 100", "thermal_pressure": "CASE WHEN i.k > 60 THEN i.k / 100 ELSE 0 END", "mem_pressure": "i.value * 100",
    "mem_used_bytes": "i.k * 1e8", "mem_total_bytes": "16e9", "disk_used_bytes": "i.value * 1e9", "disk_total_bytes": "500e9", "load1": "i.value / 20", "load5": "i.value / 25",
    "load15": "i.value / 30", "cpu_count": "8", "uptime_seconds": f"i.us / 1e6 - {GRID.start}", "up": "1", "worker_cpu_percent": "i.k", "worker_rss_bytes": "i.k * 1e7"}
MODEL_GAUGES = {
    "context_used_tokens": "i.k * 4", "context_utilization": "i.k / 100", "context_length_max_tokens": "32768", "kv_bytes_per_token": "114688", "prompt_cache_ratio": "i.k / 100",
    "in_flight": "i.k % 12"}


def increments(metric: str) -> str:
    labels, amount, where = COUNTERS[metric]
    return call_increments(metric, labels.split(), amount, where).replace("FROM ev ", "FROM ex ").replace(" AS (", " AS MATERIALIZED (", 1)


def buckets(metric: str) -> str:
    return bucket_increments(f"h_{metric}", HISTOGRAMS[metric], BOUNDS[metric], ["model"]).replace("FROM ev ", "FROM ex ").replace(" AS (", " AS MATERIALIZED (", 1)


def window(metric: str, w: int, by: str, where: str = "TRUE") -> str:
    return window_sum(f"(SELECT * FROM {metric} WHERE {where})", w, by.split())


def last(expr: str, labels: str = "", where: str = "TRUE") -> str:
    cols = "".join(f"i.{c} AS {c}, " for c in labels.split())
    return f"SELECT g.t AS t, {cols}arg_max({expr}, i.us) AS value FROM grid g JOIN (SELECT * FROM ex WHERE {where}) i ON i.us > (g.t - 300) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL"


def flow(metric, by="", w=5 * MIN, times=60.0, where="TRUE"):
    return f"SELECT * REPLACE (value / {w}.0 * {times or 1.0} AS value) FROM ({window(metric, w, by, where)})"


def grown(metric, w, by="", where="TRUE"):
    return window(metric, w, by, where)


def ratio(top, bottom, by="", w=5 * MIN, times=1.0, floor=0.0001, where="TRUE", rates=True):
    per = f" / {w}.0" if rates else ""
    keys = ", ".join(["t", *by.split()])
    return f"SELECT {keys}, {times} * ((a.value{per}) / greatest(b.value{per}, {floor})) AS value FROM ({window(top, w, by, where)}) a JOIN ({window(bottom, w, by)}) b USING ({keys})"


def scaled(inner, by):
    return f"SELECT * REPLACE (value {by} AS value) FROM ({inner})"


def total(inner, by="", fn="sum", times=""):
    keys = "".join(f", {b}" for b in by.split())
    return f"SELECT t{keys}, {fn}(value) {times} AS value FROM ({inner}) GROUP BY ALL"


def node(metric, scale=None):
    d = last(NODE_GAUGES[metric], "node")
    return d if scale is None else scaled(d, f"/ {scale}")


def model(metric):
    return last(MODEL_GAUGES[metric], "model")


def percent(part, whole):
    return f"SELECT t, node, 100 * (a.value / b.value) AS value FROM ({node(part)}) a JOIN ({node(whole)}) b USING (t, node)"


def quantile(q, metric, w=30 * MIN):
    return f"SELECT * FROM ({quantile_sql(q, '(' + window_sum(f'h_{metric}', w, ['le', 'bound']) + ')', [])})"


def quantiles(title, metric, qs, w=30 * MIN):
    return {f"{title} p{int(q * 100)}": quantile(q, metric, w) for q in qs}


def fact(attr):
    return f"SELECT *, '{attr}' AS attr FROM ({last(str(8 * (INFO.index(attr) + 1)), 'model', f'event_id % 15 = {INFO.index(attr)}')})"


INFO = ("layer_count", "kv_heads", "head_dim", "hidden_size", "attention_heads", "vocab_size", "intermediate_size", "quant_bits", "quant_group_size", "linear_key_heads",
        "linear_value_heads", "linear_key_head_dim", "linear_value_head_dim", "linear_conv_kernel_dim", "mtp_layers")
UP = " UNION ALL ".join(f"SELECT *, '{j}' AS job FROM ({last(f'CASE WHEN i.k > {k} THEN 1 ELSE 0 END', 'node')})" for j, k in (
    *((N.j(x), 5) for x in ("proxy", "hw", "kv", "supervisor", "logtailer")), ("victoria-metrics", 16), ("vmalert", 7), ("alertmanager", 12)))
ARCH = f"SELECT *, 'dense' AS arch, 'bfloat16' AS dtype FROM ({last('1', 'model')})"
CRASH = f"SELECT t, crash AS reason, value FROM ({last('CASE WHEN i.k > 50 THEN 1 ELSE 0 END', 'crash')}) WHERE value = 1"
KTYPE = "SELECT t, ktype AS type, value FROM ({})"
RISK = last("i.k / 100", "model kind")
RINGS = (f"SELECT t, node, a.value / 300.0 + b.value / 300.0 AS value FROM ({window('net_rx_errors_total', 300, 'node iface')}) a JOIN ({window('net_tx_errors_total', 300, 'node iface')}) b USING (t, node, iface)")
RESTARTS = ("SELECT g.t AS t, arg_max(i.v, i.us) AS value FROM grid g JOIN (SELECT us, count(*) OVER (PARTITION BY day ORDER BY us, event_id) AS v FROM ex WHERE category = 'error' AND k > 90) i "
            "ON i.us > (g.t - 300) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL")
SHARE = f"SELECT t, tool, 100.0 * value / greatest(sum(value) OVER (PARTITION BY t), 1) AS value FROM ({grown('tool_calls_total', 30 * DAY, 'tool')})"


def distinct(w):
    return f"SELECT t, count(*) AS value FROM ({grown('tool_calls_total', w, 'tool')}) GROUP BY t"


def level(kind, left):
    """Service level, or what is left of its budget, over 30 days; 100 without traffic."""
    w, five = 30 * DAY, "status = '5xx'"
    if kind == "availability":
        bad = f"SELECT t, a.value / greatest(b.value, 1) AS bad FROM ({window('error_total', w, '', five)}) a JOIN ({window('requests_total', w, '')}) b USING (t)"
        value = "100 * greatest(1 - bad / 0.005, 0)" if left else "100 * greatest(1 - bad, 0)"
    else:
        le = window_sum("h_ttft_seconds", w, ["le"])
        bad = (f"SELECT x.t AS t, 1 - greatest(x.value / greatest(y.value, 1), 0) AS bad FROM (SELECT * FROM ({le}) WHERE le = '10') x JOIN (SELECT * FROM ({le}) WHERE le = '+Inf') y ON x.t = y.t")
        value = "100 * greatest(1 - bad / 0.05, 0)" if left else "100 * (1 - bad)"
    return f"SELECT g.t AS t, CASE WHEN bad IS NULL THEN 100 ELSE {value} END AS value FROM grid g LEFT JOIN ({bad}) v ON v.t = g.t"


def latency_burn():
    le = window_sum("h_ttft_seconds", 300, ["le"])
    return (f"SELECT x.t AS t, (1 - greatest((x.value / 300.0) / greatest(y.value / 300.0, 0.0001), 0)) / 0.05 AS value "
            f"FROM (SELECT * FROM ({le}) WHERE le = '10') x JOIN (SELECT * FROM ({le}) WHERE le = '+Inf') y ON x.t = y.t")


CALLS, ERRORS, FIVE = "tool_calls_total", "error_total", "status = '5xx'"
WORKER = {"worker rss": total(node("worker_rss_bytes"), "node")}
BOARDS = {
    "call-types": {
        "requests by kind": flow("requests_total", "kind"), "reasoning share %": ratio("requests_total", "requests_total", times=100, where="kind = 'reasoning'"),
        "stream vs sync": flow("requests_total", "kind streaming"), "prompt tokens": flow("tokens_prompt_total", "kind", times=None),
        "completion tokens": flow("tokens_completion_total", "kind", times=None), "tool calls by kind": flow(CALLS, "kind"), "finish reason by kind": flow("finish_reason_total", "reason kind"),
        "tool calls by tool": flow(CALLS, "tool"), "tool calls by type": flow(CALLS, "type"), "avg prompt tokens": ratio("tokens_prompt_total", "requests_total", "kind"),
        "avg completion tokens": ratio("tokens_completion_total", "requests_total", "kind"), "error ratio %": ratio(ERRORS, "requests_total", "kind", times=100),
        "temperature": RISK, "hallucination risk": RISK, "hallucination flags": flow("hallucination_flag_total"),
        "reasoning share 24h": ratio("requests_total", "requests_total", w=DAY, times=100, floor=1, where="kind = 'reasoning'", rates=False)},
    "gpu-power": {
        "gpu utilization": node("gpu_utilization_percent"), "gpu iokit utilization": node("gpu_iokit_util_percent"), "gpu frequency": node("gpu_frequency_mhz"),
        "gpu memory used": node("gpu_mem_used_bytes", GIB), "gpu memory alloc": node("gpu_mem_alloc_bytes", GIB), "gpu memory %": percent("gpu_mem_used_bytes", "gpu_mem_total_bytes"),
        "gpu power": node("gpu_power_milliwatts", 1000.0), "cpu power": node("cpu_power_milliwatts", 1000.0), "ane power": node("ane_power_milliwatts", 1000.0),
        "package power": node("package_power_milliwatts", 1000.0), "thermal pressure": node("thermal_pressure"),
        "nodes online": f"SELECT t, count(*) AS value FROM ({last('CASE WHEN i.k > 5 THEN 1 ELSE 0 END', 'node')}) WHERE value = 1 GROUP BY t",
        "gpu memory total": total(node("gpu_mem_used_bytes"), times=f"/ {GIB}")},
    "http": {
        "requests by streaming": flow("requests_total", "streaming"), "requests by kind": flow("requests_total", "kind"), "in flight": total(model("in_flight")),
        "requests 24h": grown("requests_total", DAY), "errors by status": flow(ERRORS, "status"), "errors by kind": flow(ERRORS, "kind"),
        "error ratio %": ratio(ERRORS, "requests_total", times=100), "upstream reachable": last("CASE WHEN i.k > 3 THEN 1 ELSE 0 END"),
        **quantiles("ttft", "ttft_seconds", (0.5, 0.95, 0.99)), **quantiles("generation", "generation_seconds", (0.5, 0.95)),
        **quantiles("token rate", "token_rate_tokens_per_second", (0.5, 0.95)), "prompt tokens": flow("tokens_prompt_total", times=None),
        "completion tokens": flow("tokens_completion_total", times=None), "avg tokens per request": ratio("tokens_prompt_total", "requests_total", w=10 * MIN), "tool calls": flow(CALLS),
        "hallucination flags": flow("hallucination_flag_total"), "tool calls by tool": flow(CALLS, "tool"), "finish reason": flow("finish_reason_total", "reason"), "temperature": RISK,
        "context used": model("context_used_tokens"), "context utilization": model("context_utilization"), "prompt cache ratio": model("prompt_cache_ratio"),
        "cumulative cache hit %": ratio("prompt_cached_tokens_total", "tokens_prompt_total", w=10 * MIN, times=100, floor=1, rates=False),
        "cached tokens": flow("prompt_cached_tokens_total"), **quantiles("queue wait", "queue_wait_seconds", (0.5, 0.95)), "low confidence responses": flow("low_confidence_response_total")},
    "logs": {
        "lines by severity": flow("log_tailer_lines_total", "severity"), "lines by category": flow("log_tailer_lines_total", "category"), "shipped": flow("log_tailer_shipped_total"),
        "dropped by reason": flow("log_tailer_dropped_total", "reason"), "tailer errors": flow("log_tailer_errors_total"), "queue depth": last("i.k"), "file bytes": last("i.k"),
        "tailer up": last("CASE WHEN i.k > 2 THEN 1 ELSE 0 END"), "worker cpu": total(node("worker_cpu_percent"), "node"), **WORKER, "server state": last("i.k % 4")},
    "model-internals": {
        "architecture": ARCH, **{a.replace("_", " "): fact(a) for a in INFO}, **WORKER, "gpu memory used": node("gpu_mem_used_bytes"), "gpu utilization": node("gpu_utilization_percent"),
        "ring rx": flow("net_rx_bytes_total", "node", times=None), "ring tx": flow("net_tx_bytes_total", "node", times=None), "ring errors": RINGS,
        "kv bytes by type": KTYPE.format(last("i.k * 1e6", "ktype")), "kv utilization": last("i.k / 100"), "kv sequences by type": KTYPE.format(last("i.k", "ktype")),
        "kv bytes per token": f"SELECT t, value FROM ({model('kv_bytes_per_token')})", "kv bytes at max context": last("i.k * 1e6"), "max sequences": last("10"),
        "max context": model("context_length_max_tokens"), "context used": model("context_used_tokens"), "context utilization": model("context_utilization"),
        "kv bytes per token (model)": model("kv_bytes_per_token")},
    "model": {
        **{a.replace("_", " "): fact(a) for a in INFO if not a.startswith(("linear", "mtp"))}, "architecture": ARCH, "max context": model("context_length_max_tokens"),
        "kv bytes per token": model("kv_bytes_per_token"), "kv at max context": last("114688.0 * 32768", "model"),
        "context utilization %": total(model("context_utilization"), fn="max", times="* 100"), "context used": model("context_used_tokens"), "context utilization": model("context_utilization"),
        "server uptime": last("i.k * 60"), "restarts": RESTARTS, "last crash reason": CRASH,
        "scoring coverage %": ratio("confidence_scored_total", "requests_total", w=30 * MIN, times=100)},
    "node": {
        **{f"{m}": node(m) for m in ("load1", "load5", "load15", "gpu_frequency_mhz", "gpu_utilization_percent", "gpu_power_milliwatts", "package_power_milliwatts", "thermal_pressure",
                                     "mem_used_bytes", "mem_total_bytes", "mem_pressure", "cpu_count", "uptime_seconds", "up")},
        "memory used %": percent("mem_used_bytes", "mem_total_bytes"), "worker rss": node("worker_rss_bytes"), "worker cpu": node("worker_cpu_percent"),
        "gpu memory used %": percent("gpu_mem_used_bytes", "gpu_mem_total_bytes"), "gpu memory used": node("gpu_mem_used_bytes", GIB), "gpu memory alloc": node("gpu_mem_alloc_bytes", GIB),
        "cpu power": node("cpu_power_milliwatts", 1000.0), "ane power": node("ane_power_milliwatts", 1000.0), "disk used %": percent("disk_used_bytes", "disk_total_bytes"),
        "requests": flow("requests_total", "model", MIN), **quantiles("ttft", "ttft_seconds", (0.5, 0.95), 5 * MIN),
        **quantiles("token rate", "token_rate_tokens_per_second", (0.5, 0.95), 5 * MIN), "in flight": model("in_flight"), "errors": flow(ERRORS, "status", MIN, None), "telemetry up": UP},
    "sre": {
        "availability sli": level("availability", False), "availability budget left": level("availability", True), "latency sli": level("latency", False),
        "latency budget left": level("latency", True), "requests 30d": grown("requests_total", 30 * DAY), "5xx 30d": grown(ERRORS, 30 * DAY, where=FIVE),
        "4xx 30d": grown(ERRORS, 30 * DAY, where="status = '4xx'"), "serving uptime": last("i.k * 60"), "5xx ratio %": ratio(ERRORS, "requests_total", times=100, where=FIVE),
        "ttft p95": quantile(0.95, "ttft_seconds"), "availability burn": scaled(ratio(ERRORS, "requests_total", where=FIVE), "/ 0.005"), "latency burn": latency_burn()},
    "tools": {
        "tool calls": grown(CALLS, 30 * DAY), "distinct tools": distinct(30 * DAY), "tools active 7d": distinct(7 * DAY), "tools active 24h": distinct(DAY), "tool calls by tool": flow(CALLS, "tool"),
        "tool calls by type": flow(CALLS, "type"), "all tools": grown(CALLS, 30 * DAY, "tool type"), "tool calls 24h": grown(CALLS, DAY, "tool"), "share of calls": SHARE,
        "tool calls by kind": flow(CALLS, "kind")},
}


#: Interpolated quantiles often end on half a millionth, where two orders of arithmetic round apart; both sides add this before rounding.
NUDGE = {"http": 1e-9}


def board_sql(name: str) -> str:
    """The panels of a board, stacked; labels that a panel lacks are empty."""
    used = " ".join(BOARDS[name].values())
    ctes = [FAST_EV, EX, grid_cte(GRID), *[increments(m) for m in COUNTERS if f"FROM {m} " in used], *[buckets(m) for m in HISTOGRAMS if f"h_{m}" in used]]
    none = ", ".join(f"''::VARCHAR AS {c}" for c in ("panel", *DB.PANEL_LABELS))
    parts = [f"SELECT {none}, 0::BIGINT AS t, 0::DOUBLE AS value WHERE FALSE", *[f"SELECT '{title}' AS panel, * FROM ({sql})" for title, sql in BOARDS[name].items()]]
    show = ", ".join(f"coalesce({c}::VARCHAR, '') AS {c}" for c in DB.PANEL_LABELS)
    return f"WITH {', '.join(ctes)} SELECT panel, {show}, t::BIGINT AS t, round(value::DOUBLE + {NUDGE.get(name, 0.0)}, 6) AS value FROM ({' UNION ALL BY NAME '.join(parts)})"


def _register(name: str) -> None:
    @query(f"board_{name.replace('-', '_')}", board_sql(name))
    def show(spark, sf):
        s = source(spark, sf)
        d = DB.board(name, DB.roll_up_for(s, [name]))
        return out(d.withColumn("value", d["value"] + NUDGE.get(name, 0.0)))


for _name in DB.PANELS:
    _register(_name)

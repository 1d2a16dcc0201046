"""Dashboard panels over the derived samples, one query per operator combination."""


from servelens.naming import BOUNDS
from servelens.operators import vector as V
from servelens.plans import dashboards as DB
from servelens.plans import rules as R

from .adapters import bucket_increments, call_increments, out, quantile_sql, window_sum
from .alerting import BASE_STATES, ERR, G, REQ
from .registry import query
from .serving import FAST_EV, source

WITH = f"WITH {FAST_EV}, {G}, "


def show(spark, sf, board, name, **variables):
    return out(DB.panel(board, name, source(spark, sf), variables))


def last_sql(value: str, by: list[str], where: str = "TRUE", name: str = "v", look: int = 300) -> str:
    lab = "".join(f"i.{b}, " for b in by)
    return (f"{name} AS (SELECT g.t AS t, {lab}arg_max({value}, i.us) AS value FROM grid g JOIN (SELECT * FROM ev WHERE {where}) i "
            f"ON i.us > (g.t - {look}) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL)")


@query("panel_requests_by_kind", f"{WITH}{REQ} SELECT t, kind, round(value / 300.0 * 60, 6) AS value FROM ({window_sum('req', 300, ['kind'])})")
def panel_requests_by_kind(spark, sf):
    return show(spark, sf, "call-types", "requests by kind")


@query("panel_requests_one_model", f"{WITH}{REQ} SELECT t, streaming, round(value / 300.0 * 60, 6) AS value FROM ({window_sum('(SELECT * FROM req WHERE model = $$m1$$)', 300, ['streaming'])})")
def panel_requests_one_model(spark, sf):
    return show(spark, sf, "http", "requests by streaming", model="m1")


@query("panel_reasoning_share", f"""{WITH}{REQ}, a AS ({window_sum("(SELECT * FROM req WHERE kind = 'reasoning')", 300, [])}), b AS ({window_sum('req', 300, [])})
       SELECT t, round(100 * (a.value / 300.0) / greatest(b.value / 300.0, 0.0001), 6) AS value FROM a JOIN b USING (t)""")
def panel_reasoning_share(spark, sf):
    return show(spark, sf, "call-types", "reasoning share %")


@query("panel_error_ratio", f"""{WITH}{ERR}, {REQ}, a AS ({window_sum('err', 300, ['kind'])}), b AS ({window_sum('req', 300, ['kind'])})
       SELECT t, kind, round(100 * (a.value / 300.0) / greatest(b.value / 300.0, 0.0001), 6) AS value FROM a JOIN b USING (t, kind)""")
def panel_error_ratio(spark, sf):
    return show(spark, sf, "call-types", "error ratio %")


@query("panel_cache_hit", f"""{WITH}{call_increments('ca', ['model', 'kind'], 'k')}, {call_increments('tp', ['model', 'kind'], 'k * 3')},
       a AS ({window_sum('ca', 600, [])}), b AS ({window_sum('tp', 600, [])}) SELECT t, round(100 * a.value / greatest(b.value, 1), 6) AS value FROM a JOIN b USING (t)""")
def panel_cache_hit(spark, sf):
    return show(spark, sf, "http", "cumulative cache hit %")


@query("panel_ttft_p95", f"""{WITH}{bucket_increments('bk', 'ttft', BOUNDS['ttft_seconds'], ['model'])}, v AS ({window_sum('bk', 1800, ['le', 'bound'])})
       SELECT t, round(value, 6) AS value FROM ({quantile_sql(0.95, 'v', [])})""")
def panel_ttft_p95(spark, sf):
    return show(spark, sf, "http", "ttft p95")


@query("panel_upstream_reachable", f"""{WITH}{last_sql('CASE WHEN i.k > 3 THEN 1 ELSE 0 END', [])} SELECT t, value::DOUBLE AS value FROM v""")
def panel_upstream_reachable(spark, sf):
    return show(spark, sf, "http", "upstream reachable")


@query("panel_in_flight", f"{WITH}{last_sql('i.k % 12', ['model'])} SELECT t, sum(value)::DOUBLE AS value FROM v GROUP BY t")
def panel_in_flight(spark, sf):
    return show(spark, sf, "http", "in flight")


@query("panel_gpu_memory_percent", f"{WITH}{last_sql('i.k * 1e8', ['node'])} SELECT t, node, round(value / 16e9 * 100, 6)::DOUBLE AS value FROM v")
def panel_gpu_memory_percent(spark, sf):
    return show(spark, sf, "gpu-power", "gpu memory %")


@query("panel_gpu_power_node", f"{WITH}{last_sql('i.k * 100', ['node'], 'node = $$n2$$')} SELECT t, node, round(value / 1000, 6)::DOUBLE AS value FROM v")
def panel_gpu_power_node(spark, sf):
    return show(spark, sf, "gpu-power", "gpu power", node="n2")


@query("panel_nodes_online", f"{WITH}{last_sql('CASE WHEN i.k > 5 THEN 1 ELSE 0 END', ['node'])} SELECT t, count(*)::DOUBLE AS value FROM v WHERE value = 1 GROUP BY t")
def panel_nodes_online(spark, sf):
    return show(spark, sf, "gpu-power", "nodes online")


@query("panel_lines_by_category", f"{WITH}{call_increments('ln', ['event_type', 'sev'], '1').replace('FROM ev', 'FROM (SELECT *, k % 3 = 0 AS sev FROM ev)')} "
       f"SELECT t, event_type AS category, round(value / 300.0 * 60, 6) AS value FROM ({window_sum('ln', 300, ['event_type'])})")
def panel_lines_by_category(spark, sf):
    return show(spark, sf, "logs", "lines by category")


@query("panel_ring_errors", f"""{WITH}{call_increments('rx', ['node'], '1', 'k = 3')}, {call_increments('tx', ['node'], '1', 'k = 4')},
       a AS ({window_sum('rx', 300, ['node'])}), b AS ({window_sum('tx', 300, ['node'])}) SELECT t, node, round((a.value + b.value) / 300.0, 6) AS value FROM a JOIN b USING (t, node)""")
def panel_ring_errors(spark, sf):
    return show(spark, sf, "model-internals", "ring errors")


@query("panel_kv_bytes_by_type", f"""{WITH}{last_sql('i.k * 1e6', ['ty'], 'TRUE').replace('FROM ev WHERE', "FROM (SELECT *, ['total', 'user', 'assistant', 'system'][(k % 4 + 1)::INT] AS ty FROM ev) WHERE")}
       SELECT t, ty AS type, value::DOUBLE AS value FROM v""")
def panel_kv_bytes_by_type(spark, sf):
    return show(spark, sf, "model-internals", "kv bytes by type")


@query("panel_kv_at_max", f"{WITH}{last_sql('114688.0 * 32768', ['model'])} SELECT t, model, value::DOUBLE AS value FROM v")
def panel_kv_at_max(spark, sf):
    return show(spark, sf, "model", "kv at max context")


@query("panel_context_utilization", f"{WITH}{last_sql('i.k / 100', ['model'])} SELECT t, round(max(value) * 100, 6)::DOUBLE AS value FROM v GROUP BY t")
def panel_context_utilization(spark, sf):
    return show(spark, sf, "model", "context utilization %")


@query("panel_last_crash_reason", f"""{WITH}{last_sql('CASE WHEN i.k > 50 THEN 1 ELSE 0 END', ['r']).replace('FROM ev WHERE', "FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'metal_gpu_error' ELSE 'oom' END AS r FROM ev) WHERE")}
       SELECT t, r AS reason, 1.0::DOUBLE AS value FROM v WHERE value = 1""")
def panel_last_crash_reason(spark, sf):
    return show(spark, sf, "model", "last crash reason")


@query("panel_scoring_coverage", f"""{WITH}{call_increments('sc', ['model', 'k2'], '1', "model <> 'm2'").replace('FROM ev', 'FROM (SELECT *, k % 2 AS k2 FROM ev)')}, {REQ},
       a AS ({window_sum('sc', 1800, [])}), b AS ({window_sum('req', 1800, [])}) SELECT t, round(100 * (a.value / 1800.0) / greatest(b.value / 1800.0, 0.0001), 6) AS value FROM a JOIN b USING (t)""")
def panel_scoring_coverage(spark, sf):
    return show(spark, sf, "model", "scoring coverage %")


@query("panel_model_fact_last", f"{WITH}{last_sql('8', ['model'], 'event_id % 15 = 0')} SELECT model, 'layer_count' AS attr, max(t) AS t, 8.0::DOUBLE AS value FROM v GROUP BY 1")
def panel_model_fact_last(spark, sf):
    return V.last_not_null(DB.panel("model", "layer count", source(spark, sf)))


TOOLS = call_increments("tl", ["model", "kind", "tool"], "1", "k % 2 = 0").replace("FROM ev", "FROM (SELECT *, 't' || (k % 5) AS tool FROM ev)")


@query("panel_tool_share", f"""{WITH}{TOOLS}, v AS ({window_sum('tl', 2592000, ['tool'])})
       SELECT t, tool, round(100.0 * value / greatest(sum(value) OVER (PARTITION BY t), 1), 6) AS value FROM v""")
def panel_tool_share(spark, sf):
    return show(spark, sf, "tools", "share of calls")


@query("panel_distinct_tools", f"{WITH}{TOOLS} SELECT t, count(*)::DOUBLE AS value FROM ({window_sum('tl', 2592000, ['tool'])}) GROUP BY t")
def panel_distinct_tools(spark, sf):
    return show(spark, sf, "tools", "distinct tools")


@query("panel_latency_burn", f"""{WITH}{bucket_increments('bk', 'ttft', BOUNDS['ttft_seconds'], ['model'])}, a AS ({window_sum('bk', 300, ['le'])})
       SELECT x.t, round((1 - greatest((x.value / 300.0) / greatest(y.value / 300.0, 0.0001), 0)) / 0.05, 6) AS value FROM a x JOIN a y ON x.t = y.t AND x.le = '10' AND y.le = '+Inf'""")
def panel_latency_burn(spark, sf):
    return show(spark, sf, "sre", "latency burn")


@query("panel_availability_burn", f"""{WITH}{call_increments('e5', ['model', 'kind'], 'k', 'status >= 500')}, {REQ}, a AS ({window_sum('e5', 300, [])}), b AS ({window_sum('req', 300, [])})
       SELECT t, round((a.value / 300.0) / greatest(b.value / 300.0, 0.0001) / 0.005, 6) AS value FROM a JOIN b USING (t)""")
def panel_availability_burn(spark, sf):
    return show(spark, sf, "sre", "availability burn")


@query("panel_firing_count", f"""WITH {FAST_EV}, {G}, {ERR}, {BASE_STATES}, c AS (SELECT t, count(*) AS n FROM st WHERE state = 'firing' GROUP BY t)
       SELECT g.t AS t, coalesce(c.n, 0)::DOUBLE AS value FROM grid g LEFT JOIN c ON c.t = g.t""")
def panel_firing_count(spark, sf):
    s = source(spark, sf)
    return DB.firing_count(R.evaluate(s, ["HighErrorRate"]), s)


@query("panel_gpu_heatmap", f"""WITH {FAST_EV}, x AS (SELECT us, node, least(value / 4, 100) AS v FROM ev), lim AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
       SELECT (us // 600000000) * 600 AS t, node, b AS bin, round(lo + b * (hi - lo) / 24.0, 6) AS lower, count(*) AS n
       FROM (SELECT us, node, lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 24.0)), 23) AS INTEGER) AS b FROM x, lim) GROUP BY ALL""")
def panel_gpu_heatmap(spark, sf):
    return out(DB.heatmap(source(spark, sf), step=600))



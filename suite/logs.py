"""Log lines, crashes, host text, counters and model configs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from servelens.functions.scalars import gib, parse_size, percent_of, watts
from servelens.operators import host as H
from servelens.operators import logs as G

from .adapters import EV, events, out, table
from .registry import query

KINDS = (
    ("k % 12 = 0", "'[METAL] Command buffer execution failed: code ' || k"), ("k % 12 = 1", "'[WARN] Node with rank 1 slow'"),
    ("k % 12 = 2", "'Traceback (most recent call last) in worker ' || k"), ("k % 12 = 3", "'request failed with fault ' || k"),
    ("k % 12 = 4", "'Prompt Cache: ' || (k % 10) || ' sequences, ' || (k / 100.0) || ' GB'"),
    ("k % 12 = 5", "'  - ' || CASE WHEN k % 2 = 0 THEN 'user' WHEN k % 3 = 0 THEN 'system' ELSE 'assistant' END || ': ' || (k % 7) || ' sequences, ' || (k / 200.0) || ' GB'"),
    ("k % 12 = 6", "'127.0.0.1 - POST /v1/chat/completions 200'"), ("k % 12 = 7", "'GET /v1/models error 500'"),
    ("k % 12 = 8", "'prefill 512 tokens/s, ttft 0.4'"), ("k % 12 = 9", "'worker killed: out of memory'"), ("k % 12 = 10", "''"))
CASE = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in KINDS) + " ELSE 'plain output ' || k END"
LINES = EV + f""", ln0 AS (SELECT node AS source, event_id AS seq, us, k, event_type, {CASE} AS line FROM ev),
       ln AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY source ORDER BY seq) - length(line) - 1 AS BIGINT) AS byte_offset FROM ln0)"""
WORDLINE = r"(Traceback|Fatal Python error|SIGABRT|SIGSEGV|SIGKILL|segmentation fault|KeyboardInterrupt|killed|OutOfMemory|CUDA|MLX error|RuntimeError)"
CLASSIFIED = LINES + f""", cl AS (SELECT *, CASE
       WHEN regexp_matches(line, '\\[METAL\\]|Command buffer execution failed|kIOGPUCommandBuffer|GPU error', 'i') THEN 'error/gpu'
       WHEN regexp_matches(line, '\\[WARN\\]|Node with rank|rank\\s+\\d+.*(failed|down|offline)|exited with code', 'i') THEN 'warning/rank'
       WHEN regexp_matches(line, '\\b{WORDLINE}\\b', 'i') THEN 'error/python' WHEN regexp_matches(line, '\\b(error|failed|fault)\\b', 'i') THEN 'error/python'
       WHEN regexp_matches(line, '\\b(tokens/s|ttft|gen:.*ms|generation|prefill|prompt cache)\\b', 'i') THEN 'info/generation'
       WHEN regexp_matches(line, '(POST|GET|DELETE|PUT) /') THEN 'info/http' ELSE 'info/other' END AS c FROM ln WHERE line <> '')"""


def lines(spark, sf):
    """Server log lines built from ``events``: source = node, in event order."""
    d = events(spark, sf).select(F.col("node").alias("source"), F.col("event_id").alias("seq"), "ts", "us", "k", "event_type",
                                 F.expr(CASE.replace("k / 100.0", "k / 100D").replace("k / 200.0", "k / 200D")).alias("line"))
    w = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("byte_offset", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))


def classified(spark, sf):
    return G.classify_lines(G.clean_lines(lines(spark, sf)))


@query("g_classify_lines", CLASSIFIED.join(["WITH ", " SELECT seq, split_part(c, '/', 1) AS severity, split_part(c, '/', 2) AS category FROM cl"]))
def g_classify_lines(spark, sf):
    return classified(spark, sf).select("seq", "severity", "category")


@query("g_severity_number", f"""WITH {CLASSIFIED} SELECT CASE split_part(c, '/', 1) WHEN 'error' THEN 17 WHEN 'warning' THEN 13 ELSE 9 END AS number,
       count(*) AS n FROM cl GROUP BY 1""")
def g_severity_number(spark, sf):
    return classified(spark, sf).groupBy(G.severity_number(F.col("severity")).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("g_line_counts", f"""WITH {CLASSIFIED} SELECT (us // 86400000000) * 86400 AS t, split_part(c, '/', 1) AS severity,
       split_part(c, '/', 2) AS category, count(*) AS n FROM cl GROUP BY ALL""")
def g_line_counts(spark, sf):
    return G.line_counts(classified(spark, sf), 86400)


@query("p_drop_noise_lines", f"WITH {CLASSIFIED} SELECT split_part(c, '/', 2) AS category, count(*) AS n FROM cl WHERE c NOT LIKE '%/http' GROUP BY 1")
def p_drop_noise_lines(spark, sf):
    return G.drop_noise_lines(classified(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def limited(spark, sf):
    """Lines squeezed in time by 20,000, so that the bucket runs dry."""
    d = classified(spark, sf)
    return G.rate_limit(d.withColumn("ts", F.timestamp_micros(F.floor(F.col("us") / 20000).cast("bigint"))), 20.0, 60)


BUCKET = CLASSIFIED.replace("ev AS (", "RECURSIVE ev AS (", 1) + """, q AS MATERIALIZED (SELECT source, seq, c, (us // 20000) / 1e6 AS s, row_number() OVER (PARTITION BY source ORDER BY us // 20000, seq) AS n FROM cl),
       tb AS (SELECT source, n, s, 49.0::DOUBLE AS tokens, TRUE AS accepted, c FROM q WHERE n = 1 UNION ALL
       SELECT source, n, s, CASE WHEN x >= 1 THEN x - 1 ELSE x END, x >= 1, c FROM (
         SELECT q.source, q.n, q.s, q.c, least(50.0::DOUBLE, tb.tokens + (q.s - tb.s) * 20.0) AS x FROM tb JOIN q ON q.source = tb.source AND q.n = tb.n + 1))"""


@query("g_rate_limit", f"WITH {BUCKET} SELECT source, accepted, count(*) AS n FROM tb GROUP BY ALL")
def g_rate_limit(spark, sf):
    return limited(spark, sf).groupBy("source", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("g_dropped_counts", f"WITH {BUCKET} SELECT CASE WHEN c = 'info/http' THEN 'http_filter' ELSE 'rate_limit' END AS reason, count(*) AS n FROM tb "
       "WHERE c = 'info/http' OR NOT accepted GROUP BY 1")
def g_dropped_counts(spark, sf):
    return G.dropped_counts(limited(spark, sf))


CACHE = LINES + """, m AS (SELECT source, seq, CASE WHEN k % 12 = 4 THEN 'total' WHEN k % 2 = 0 THEN 'user' WHEN k % 3 = 0 THEN 'system' ELSE 'assistant' END AS type,
       CASE WHEN k % 12 = 4 THEN k % 10 ELSE k % 7 END AS sequences, CASE WHEN k % 12 = 4 THEN k / 100.0 ELSE k / 200.0 END * 1e9 AS bytes
       FROM ln WHERE k % 12 IN (4, 5)), o AS (SELECT source, max(seq) AS s FROM m WHERE type = 'total' GROUP BY 1),
       b AS (SELECT source, type, arg_max(sequences, seq) AS sequences, arg_max(bytes, seq) AS bytes FROM m JOIN o USING (source) WHERE seq >= s GROUP BY ALL)"""


@query("g_kv_cache_blocks", f"""WITH {CACHE} SELECT d.source, d.type, coalesce(b.sequences, 0)::BIGINT AS sequences, round(coalesce(b.bytes, 0), 1)::DOUBLE AS bytes
       FROM (SELECT DISTINCT source, unnest(['total', 'assistant', 'user', 'system']) AS type FROM ln) d LEFT JOIN b USING (source, type)""")
def g_kv_cache_blocks(spark, sf):
    return out(G.kv_cache_blocks(lines(spark, sf)), 1)


@query("g_kv_utilization", f"""WITH {CACHE} SELECT source, round(CASE WHEN coalesce(max(bytes) FILTER (type = 'total'), 0) <> 0 THEN max(bytes) FILTER (type = 'total')
       ELSE max(bytes) END / (10 * 4.7e9), 6)::DOUBLE AS utilization FROM b GROUP BY 1""")
def g_kv_utilization(spark, sf):
    return out(G.kv_utilization(lines(spark, sf), F.lit(4.7e9)).select("source", "utilization"))


def exits(spark, sf):
    return lines(spark, sf).where("event_type = 'error'").select(
        "source", "ts", F.col("seq").alias("exit_id"), "byte_offset", F.col("source").alias("node"),
        F.when(F.col("k") % 2 == 0, -15).otherwise(255).alias("exit_code"))


REASON = LINES + """, ex AS (SELECT source, us, seq AS exit_id, byte_offset, k FROM ln WHERE event_type = 'error'),
       tl AS (SELECT e.source, e.exit_id, any_value(e.us) AS us, min(CASE
         WHEN l.k IS NULL THEN 9 WHEN regexp_matches(x, '\\[METAL\\].*(Command buffer execution failed|GPU errors)', 'i') THEN 0
         WHEN regexp_matches(x, '\\b(out of memory|OOM|allocation failed)\\b', 'i') THEN 2
         WHEN regexp_matches(x, '\\b(traceback|killed|segmentation fault|SIGABRT)\\b', 'i') THEN 3 ELSE 9 END) AS p
       FROM ex e LEFT JOIN LATERAL (SELECT k, substr(line, CAST(greatest(e.byte_offset - NB - byte_offset, 0) + 1 AS BIGINT)) AS x FROM ln l
         WHERE l.source = e.source AND l.byte_offset < e.byte_offset AND l.byte_offset + length(l.line) > e.byte_offset - NB) l ON TRUE GROUP BY ALL),
       rs AS (SELECT source, exit_id, us, CASE p WHEN 0 THEN 'metal_gpu_error' WHEN 2 THEN 'oom' WHEN 3 THEN 'python_error' ELSE 'exit' END AS reason FROM tl)"""
REASON = REASON.replace("NB", "120")


def reasoned(spark, sf):
    return G.crash_reason(exits(spark, sf), lines(spark, sf).select("source", "byte_offset", "line"), 120)


@query("g_crash_reason", f"WITH {REASON} SELECT source, exit_id, reason FROM rs")
def g_crash_reason(spark, sf):
    return reasoned(spark, sf).select("source", "exit_id", "reason")


@query("g_crash_ledger", f"""WITH {REASON}, h AS (SELECT DISTINCT us // 3600000000 AS h FROM rs) SELECT h * 3600 AS t, reason, count(r.us) AS crashes
       FROM (SELECT h, unnest(['metal_gpu_error', 'oom', 'python_error', 'exit', 'unknown']) AS reason FROM h) d
       LEFT JOIN (SELECT us, us // 3600000000 AS h, reason FROM rs) r USING (h, reason) GROUP BY ALL""")
def g_crash_ledger(spark, sf):
    return G.crash_ledger(reasoned(spark, sf)).select(F.unix_seconds("hour").alias("t"), "reason", "crashes")


@query("g_last_crash_reason", f"""WITH {REASON}, l AS (SELECT source, arg_max(reason, exit_id) AS last FROM rs GROUP BY 1)
       SELECT source, reason, CASE WHEN reason = last THEN 1.0 ELSE 0.0 END::DOUBLE AS value
       FROM (SELECT *, unnest(['metal_gpu_error', 'oom', 'python_error', 'exit', 'unknown']) AS reason FROM l)""")
def g_last_crash_reason(spark, sf):
    return G.last_crash_reason(reasoned(spark, sf))


@query("g_restarts_per_hour", f"WITH {REASON} SELECT (us // 3600000000) * 3600 AS t, count(*) AS restarts FROM rs GROUP BY 1")
def g_restarts_per_hour(spark, sf):
    return G.restarts_per_hour(reasoned(spark, sf)).select(F.unix_seconds("hour").alias("t"), "restarts")


@query("g_probe_outcomes", f"""WITH {EV} SELECT node, sum((k % 10 = 0)::INT)::BIGINT AS ok, sum((k % 10 <> 0)::INT)::BIGINT AS fail,
       sum((k % 10 <> 0)::INT) > 6 * (sum((k % 10 = 0)::INT) + 0.01) AS failing FROM ev GROUP BY 1""")
def g_probe_outcomes(spark, sf):
    p = events(spark, sf).select("node", F.when(F.col("k") % 10 == 0, "ok").otherwise("fail").alias("result"))
    return G.probe_outcomes(p, ["node"])


@query("g_serving_states", f"""WITH {EV}, e AS (SELECT node AS source, event_id AS seq, CASE WHEN k < 5 THEN 'exit' WHEN k < 20 THEN 'spawn' WHEN k = 20 THEN 'stop'
         WHEN k < 70 THEN 'ok' ELSE 'fail' END AS event FROM ev), a AS (
       SELECT *, sum((event = 'exit')::INT) OVER w AS ne, last_value(CASE event WHEN 'spawn' THEN 1 WHEN 'exit' THEN 0 WHEN 'stop' THEN 0 END IGNORE NULLS) OVER w AS alive
       FROM e WINDOW w AS (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING)), s AS (
       SELECT *, CASE WHEN event = 'spawn' THEN 2 WHEN event = 'stop' THEN 0 WHEN event = 'exit' AND ne > 1 THEN 3 WHEN event = 'ok' AND alive = 1 THEN 1 END AS st FROM a), f AS (
       SELECT *, last_value(st IGNORE NULLS) OVER w AS cur, last_value(CASE WHEN st IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS set_at,
       last_value(CASE WHEN event = 'fail' THEN seq END IGNORE NULLS) OVER w AS bad FROM s WINDOW w AS (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING))
       SELECT source, seq, event, CASE WHEN cur = 1 AND bad > set_at THEN 2 ELSE coalesce(cur, 0) END AS state FROM f""")
def g_serving_states(spark, sf):
    k = F.col("k")
    e = events(spark, sf).select(F.col("node").alias("source"), "ts", F.col("event_id").alias("seq"),
                                 F.when(k < 5, "exit").when(k < 20, "spawn").when(k == 20, "stop").when(k < 70, "ok").otherwise("fail").alias("event"))
    return G.serving_states(e, 21600).select("source", "seq", "event", "state")


@query("g_cascade_origin", f"""WITH {EV}, x AS (SELECT node, event_id, us, CASE WHEN k % 2 = 0 THEN -15 ELSE 255 END AS code FROM ev WHERE event_type = 'error'),
       i AS (SELECT *, sum(b) OVER (ORDER BY us, event_id) AS c FROM (SELECT *, CASE WHEN us - lag(us) OVER (ORDER BY us, event_id) <= 7200000000 THEN 0 ELSE 1 END AS b FROM x))
       SELECT min(us) AS cluster_start, arg_min(node, (us, event_id)) AS first_node, arg_min(code, (us, event_id)) AS first_code, count(*) AS exits,
       count(DISTINCT node) AS nodes FROM i GROUP BY c""")
def g_cascade_origin(spark, sf):
    return G.cascade_origin(exits(spark, sf), 7200).drop("_")


# ---- host text ----

def host_text(spark, sf):
    d = events(spark, sf)
    k = F.col("k").cast("string")
    vm = F.concat(F.lit("Pages free:   "), k, F.lit(".\nPages active: 5.\n"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("Pages inactive: "), k, F.lit("."))).otherwise(""))
    pm = F.concat(F.lit("GPU HW active residency:  "), k, F.lit(".5%\nCPU Power: "), k, F.lit(" mW\nGPU Power: 10 mW\nGPU Power: "), k,
                  F.lit(" mW\nCombined Power (CPU + GPU + ANE): "), F.col("cents").cast("string"), F.lit(" mW"))
    io = F.concat(F.lit('"In use system memory"='), F.col("cents").cast("string"), F.lit(',"Device Utilization %"='), k, F.lit(',"VRAM,totalMB"=16'))
    tool = F.when(F.col("event_id") % 3 == 0, "vm_stat").when(F.col("event_id") % 3 == 1, "powermetrics").otherwise("ioreg")
    return d.select("node", "ts", "event_id", tool.alias("tool"), F.when(tool == "vm_stat", vm).when(tool == "powermetrics", pm).otherwise(io).alias("text"))


HOST = EV + """, g AS (
       SELECT 'pages_free' AS gauge, k::DOUBLE AS v FROM ev WHERE event_id % 3 = 0 UNION ALL
       SELECT 'pages_inactive', CASE WHEN k % 2 = 0 THEN k::DOUBLE END FROM ev WHERE event_id % 3 = 0 UNION ALL
       SELECT 'pages_speculative', NULL FROM ev WHERE event_id % 3 = 0 UNION ALL
       SELECT 'cpu_temp_celsius', NULL FROM ev WHERE event_id % 3 = 1 UNION ALL SELECT 'gpu_utilization_percent', k + 0.5 FROM ev WHERE event_id % 3 = 1 UNION ALL
       SELECT 'gpu_frequency_mhz', NULL FROM ev WHERE event_id % 3 = 1 UNION ALL SELECT 'ane_power_milliwatts', NULL FROM ev WHERE event_id % 3 = 1 UNION ALL
       SELECT 'cpu_power_milliwatts', k FROM ev WHERE event_id % 3 = 1 UNION ALL SELECT 'gpu_power_milliwatts', k FROM ev WHERE event_id % 3 = 1 UNION ALL
       SELECT 'package_power_milliwatts', cents FROM ev WHERE event_id % 3 = 1 UNION ALL SELECT 'gpu_mem_used_bytes', cents FROM ev WHERE event_id % 3 = 2 UNION ALL
       SELECT 'gpu_mem_alloc_bytes', NULL FROM ev WHERE event_id % 3 = 2 UNION ALL SELECT 'gpu_mem_total_bytes', 16777216 FROM ev WHERE event_id % 3 = 2 UNION ALL
       SELECT 'gpu_iokit_util_percent', k FROM ev WHERE event_id % 3 = 2)"""


@query("h_parse_host_text", f"WITH {HOST} SELECT gauge, count(*) AS n, count(v) AS readings, round(coalesce(sum(v), 0), 3)::DOUBLE AS total FROM g GROUP BY 1")
def h_parse_host_text(spark, sf):
    d = H.parse_host_text(host_text(spark, sf))
    ok = ~F.isnan("value")
    return d.groupBy("gauge").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("readings"),
                                  F.round(F.coalesce(F.sum(F.when(ok, F.col("value"))), F.lit(0.0)), 3).alias("total"))


@query("h_memory_used", f"""WITH {EV} SELECT event_id, (8589934592 - (k + CASE WHEN k % 2 = 0 THEN k ELSE 0 END) * 16384)::DOUBLE AS used FROM ev WHERE event_id % 3 = 0""")
def h_memory_used(spark, sf):
    t = host_text(spark, sf).where("tool = 'vm_stat'")
    g = H.parse_host_text(t).groupBy("node", "ts").agg(*[
        F.max(F.when(F.col("gauge") == f"pages_{n}", F.col("value"))).alias(n) for n in ("free", "inactive", "speculative")])
    return t.select("event_id", "node", "ts").join(g, ["node", "ts"]).select("event_id", H.memory_used(
        F.lit(8589934592.0), F.col("free"), F.col("inactive"), F.col("speculative"), F.lit(16384)).alias("used"))


@query("h_thermal_pressure", f"WITH {EV} SELECT event_id, round(CASE WHEN k % 3 = 0 THEN 0 ELSE greatest(0, least(1, (100 - k) / 100)) END, 6)::DOUBLE AS pressure FROM ev")
def h_thermal_pressure(spark, sf):
    text = F.when(F.col("k") % 3 == 0, "nothing").otherwise(F.concat(F.lit("x\nCPU_Scheduler_Limit:  "), F.col("k").cast("string")))
    return out(events(spark, sf).select("event_id", H.thermal_pressure(text).alias("pressure")))


NEEDLES = {"die": "der", "les": "les", "the": "the", "que": "que", "nothing": "zzzzqqq"}


def procs(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("lang").alias("node"), (F.col("doc_id") % 50).cast("double").alias("cpu"), (F.col("n_chars") % 1000).alias("rss_kb"), F.col("text").alias("command"))


@query("h_process_rollup", """WITH n AS (SELECT * FROM (VALUES ('die', 'der'), ('les', 'les'), ('the', 'the'), ('que', 'que'), ('nothing', 'zzzzqqq')) v(component, needle)),
       f AS (SELECT lang, component, sum(doc_id % 50)::DOUBLE AS cpu, sum((n_chars % 1000) * 1024)::BIGINT AS rss FROM documents JOIN n ON contains(text, needle)
       WHERE NOT contains(text, 'Exporter') GROUP BY ALL)
       SELECT d.lang AS node, d.component, coalesce(cpu, 0) AS cpu, coalesce(rss, 0) AS rss_bytes FROM (SELECT DISTINCT lang, component FROM documents, n) d
       LEFT JOIN f USING (lang, component)""")
def h_process_rollup(spark, sf):
    return H.process_rollup(procs(spark, sf), NEEDLES, ["Exporter"])


@query("j_component_match", "SELECT needle AS component, count(*) AS n FROM documents JOIN (VALUES ('der'), ('les'), ('the'), ('que')) v(needle) ON contains(text, needle) GROUP BY 1")
def j_component_match(spark, sf):
    return H.component_match(procs(spark, sf), {n: n for n in ("der", "les", "the", "que")}).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("h_worker_rollup", """SELECT lang AS node, sum(doc_id % 50)::DOUBLE AS cpu, sum((n_chars % 1000) * 1024)::BIGINT AS rss_bytes FROM documents
       WHERE contains(text, 'en') AND NOT contains(text, 'der') GROUP BY 1""")
def h_worker_rollup(spark, sf):
    return H.worker_rollup(procs(spark, sf), "en", ["der"])


@query("j_container_match", """SELECT n_name AS component, count(*) AS n, round(sum(c_nationkey + 0.5), 3)::DOUBLE AS cpu,
       sum(floor(abs(c_acctbal) * 1048576))::BIGINT AS rss_bytes FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20 GROUP BY 1""")
def j_container_match(spark, sf):
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("name"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".5%")).alias("cpu_pct"),
        F.concat(F.format_string("%.2f", F.abs("c_acctbal")), F.lit("MB / 8GB")).alias("mem_usage"))
    comp = table(spark, sf, "nation").where("n_nationkey < 20").select(
        F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("component"))
    return H.container_match(c, comp).groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cpu"), 3).alias("cpu"), F.sum("rss_bytes").alias("rss_bytes"))


@query("h_parse_size", f"""WITH {EV} SELECT event_id, floor(value * CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 WHEN 4 THEN 1099511627776.0
       ELSE 1 END)::BIGINT AS bytes FROM ev""")
def h_parse_size(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MiB", "GB", "TiB", "PB")]), (F.col("k") % 6 + 1).cast("int"))
    return events(spark, sf).select("event_id", parse_size(F.concat(F.col("value").cast("string"), unit)).alias("bytes"))


@query("h_unit_scaling", f"""WITH {EV} SELECT event_id, round(cents * 100000 / 1073741824.0, 6)::DOUBLE AS gib, round(value * 7 / 1000, 6) AS watts,
       round(k / (k + 3.0) * 100, 6)::DOUBLE AS pct FROM ev""")
def h_unit_scaling(spark, sf):
    return out(events(spark, sf).select("event_id", gib(F.col("cents") * 100000).alias("gib"), watts(F.col("value") * 7).alias("watts"),
                                        percent_of(F.col("k").cast("double"), F.col("k") + 3.0).alias("pct")))


def link_text(spark, sf):
    d = events(spark, sf)
    row = F.concat_ws(" ", F.lit("en5 1500 <Link#9> aa:bb"), (F.col("k") * 7).cast("string"), (F.col("k") % 3).cast("string"), F.col("cents").cast("string"),
                      (F.col("k") * 5).cast("string"), (F.col("k") % 2).cast("string"), (F.col("cents") * 2).cast("string"), F.lit("0"))
    text = F.concat(F.lit("Name Mtu Network Address Ipkts Ierrs Ibytes Opkts Oerrs Obytes Coll\nen5 1500 10.0 10.0.0.1 1 - 2 3 - 4 -\n"), row)
    return d.select("node", "ts", "event_id", F.lit("en5").alias("iface"), text.alias("text"))


@query("h_link_counters", f"WITH {EV} SELECT node, count(*) AS n, sum(cents)::BIGINT AS rx, sum(cents * 2)::BIGINT AS tx, sum(k % 3)::BIGINT AS rx_err, sum(k % 2)::BIGINT AS tx_err FROM ev GROUP BY 1")
def h_link_counters(spark, sf):
    return H.link_counters(link_text(spark, sf)).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rx_bytes").alias("rx"), F.sum("tx_bytes").alias("tx"), F.sum("rx_errors").alias("rx_err"), F.sum("tx_errors").alias("tx_err"))


@query("h_counter_delta", f"""WITH {EV} SELECT event_id, coalesce(greatest(cents - lag(cents) OVER w, 0), 0) AS cents_delta,
       coalesce(greatest(k - lag(k) OVER w, 0), 0) AS k_delta FROM ev WINDOW w AS (PARTITION BY node ORDER BY us, event_id)""")
def h_counter_delta(spark, sf):
    d = events(spark, sf).select("node", "ts", "event_id", "cents", "k")
    return H.counter_delta(d, ["node"], ["cents", "k"], "event_id", 86400).select("event_id", "cents_delta", "k_delta")


# ---- model configs ----

def configs(spark, sf):
    s = table(spark, sf, "supplier")
    i = F.col("s_suppkey")
    dims = F.struct(F.when(i % 5 != 0, i * 64).alias("max_position_embeddings"), (i % 40).alias("num_hidden_layers"), F.lit(8).alias("num_key_value_heads"),
                    F.when(i % 3 != 0, 128).alias("head_dim"), (i * 16).alias("hidden_size"), F.when(i % 2 == 0, "bfloat16").alias("dtype"))
    quant = F.struct((i % 8).alias("bits"), F.lit(64).alias("group_size"))
    flat = F.to_json(F.struct(F.when(i % 4 != 0, F.array(F.lit("Dense"))).alias("architectures"), quant.alias("quantization"), *[dims[c].alias(c) for c in (
        "max_position_embeddings", "num_hidden_layers", "num_key_value_heads", "head_dim", "hidden_size", "dtype")]))
    nested = F.to_json(F.struct(F.array(F.lit("Nested")).alias("architectures"), quant.alias("quantization_config"), dims.alias("text_config")))
    return s.select(F.concat(F.lit("m"), i.cast("string")).alias("model"), F.when(i % 2 == 0, nested).otherwise(flat).alias("config"))


CONFIG = """c AS (SELECT 'm' || s_suppkey AS model, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey > 0 THEN s_suppkey * 64 ELSE 32768 END AS max_context, s_suppkey % 40 AS layers,
       8 AS kv_heads, CASE WHEN s_suppkey % 3 <> 0 THEN 128 ELSE 0 END AS head_dim, s_suppkey * 16 AS hidden_size, s_suppkey % 8 AS quant_bits, 64 AS quant_group_size,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Nested' WHEN s_suppkey % 4 <> 0 THEN 'Dense' ELSE '' END AS arch,
       CASE WHEN s_suppkey % 2 = 0 THEN 'bfloat16' ELSE '' END AS dtype FROM supplier)"""


@query("m_model_facts", f"WITH {CONFIG} SELECT model, max_context, layers, kv_heads::BIGINT AS kv_heads, head_dim::BIGINT AS head_dim, hidden_size, quant_bits, quant_group_size::BIGINT AS quant_group_size, arch, dtype FROM c")
def m_model_facts(spark, sf):
    return H.model_facts(configs(spark, sf)).select("model", "max_context", "layers", "kv_heads", "head_dim", "hidden_size", "quant_bits", "quant_group_size", "arch", "dtype")


@query("m_kv_bytes", f"""WITH {CONFIG}, b AS (SELECT model, max_context, layers * 2 * kv_heads * head_dim * 2 AS per FROM c)
       SELECT model, per::BIGINT AS kv_bytes_per_token, (per * max_context)::BIGINT AS kv_bytes_full_context, (per * max_context * 10)::BIGINT AS kv_capacity_bytes FROM b""")
def m_kv_bytes(spark, sf):
    return H.kv_bytes(H.model_facts(configs(spark, sf))).select("model", "kv_bytes_per_token", "kv_bytes_full_context", "kv_capacity_bytes")


@query("m_model_info_long", f"""WITH {CONFIG} SELECT attr, count(*) AS n, sum(v)::DOUBLE AS total FROM (
       SELECT unnest(['layer_count', 'kv_heads', 'head_dim', 'hidden_size', 'quant_bits', 'quant_group_size']) AS attr,
       unnest([layers, kv_heads, head_dim, hidden_size, quant_bits, quant_group_size]) AS v FROM c) GROUP BY 1 UNION ALL
       SELECT unnest(['attention_heads', 'vocab_size', 'intermediate_size', 'linear_key_heads', 'linear_value_heads', 'linear_key_head_dim', 'linear_value_head_dim',
       'linear_conv_kernel_dim', 'mtp_layers', 'tie_word_embeddings']), (SELECT count(*) FROM c), 0.0""")
def m_model_info_long(spark, sf):
    return H.model_info_long(H.model_facts(configs(spark, sf))).groupBy("attr").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("m_model_arch", f"""WITH {CONFIG} SELECT model, CASE WHEN arch = '' THEN 'unknown' ELSE arch END AS arch, CASE WHEN dtype = '' THEN 'unknown' ELSE dtype END AS dtype,
       1.0::DOUBLE AS value FROM c WHERE arch <> '' OR dtype <> ''""")
def m_model_arch(spark, sf):
    return H.model_arch(H.model_facts(configs(spark, sf)))

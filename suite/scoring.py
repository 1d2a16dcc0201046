"""Traces, judge replies, benchmark results, agent runs and engine comparison."""


from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servelens.naming import BOUNDS, DEFAULT_NAMING as N
from servelens.operators import benchruns as B
from servelens.operators import stats as ST
from servelens.operators import traces as E
from servelens.operators.slices import dealt
from servelens.scratch import saved

from .adapters import EV, bucket_counts, bucket_increments, call_increments, events, grid_cte, instant_of, out, quantile_sql, table, window_sum
from .registry import query
from .serving import FAST_EV, GRID, _sample, calls

NAMES = E.JUDGE_NAMES


def traces(spark, sf):
    """One trace per conversation, messages in turn order."""
    c = table(spark, sf, "conversations")
    msg = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
                      lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    g = c.groupBy("conv_id").agg(msg.alias("messages"), F.max_by(F.when(F.col("role") == "assistant", F.col("text")),
                                                                F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"),
                                 F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("turns"))
    have = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("conv_id") * (i + 3)) % 100 / 100.0).alias("value"), F.lit(i).alias("i"))
                              for i, n in enumerate(NAMES)]), lambda s: s["i"] < F.col("conv_id") % 4)
    start = F.col("conv_id") * 600_000_000 + 1704067200_000_000
    return g.select(
        F.col("conv_id").cast("string").alias("id"), F.col("conv_id"), F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project"),
        F.timestamp_micros(start).alias("start_time"), F.timestamp_micros(start + F.col("chars") * 1000).alias("end_time"),
        F.struct(F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("m"), (F.col("conv_id") % 5).cast("string"))).alias("model"), F.col("messages")).alias("input"), F.when(F.col("answer").isNotNull(), F.struct(F.col("answer").alias("content"))).alias("output"),
        F.struct(F.col("chars").alias("total_tokens")).alias("usage"), F.when(F.col("conv_id") % 7 == 0, F.struct(F.lit("X").alias("exception_type"))).alias("error_info"),
        F.transform(have, lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"))).alias("feedback_scores"))


TRACES = """tr AS (SELECT conv_id, conv_id::VARCHAR AS id, 'p' || (conv_id % 3) AS project, sum(length(text))::BIGINT AS chars, count(*) AS turns,
       arg_max(text, turn) FILTER (role = 'user' AND text <> '') AS q, arg_max(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)"""
TRIM = "regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


@query("e_question_answer", f"WITH {TRACES} SELECT id, {TRIM.format(c='q')} AS question, {TRIM.format(c='a')} AS answer FROM tr WHERE a IS NOT NULL")
def e_question_answer(spark, sf):
    return E.question_answer(traces(spark, sf)).where("question is not null").select("id", "question", "answer")


@query("e_pending_traces", f"WITH {TRACES} SELECT id FROM tr WHERE a IS NOT NULL AND q IS NOT NULL AND {TRIM.format(c='a')} <> '' AND conv_id % 4 <> 3")
def e_pending_traces(spark, sf):
    return E.pending_traces(traces(spark, sf)).select("id")


def score_table(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id").distinct()
    return d.select(F.col("conv_id").cast("string").alias("id"), F.explode(F.array(*[F.struct(
        F.lit(n).alias("name"), ((F.col("conv_id") * (i + 3)) % 101 / 100.0).alias("value"), (F.col("conv_id") % (i + 2)).alias("version")) for i, n in enumerate(NAMES)])).alias("s")).select("id", "s.*")


@query("e_pending_by_table", f"WITH {TRACES} SELECT id FROM tr WHERE a IS NOT NULL AND q IS NOT NULL AND {TRIM.format(c='a')} <> '' AND conv_id % 5 = 0 AND conv_id % 4 <> 3")
def e_pending_by_table(spark, sf):
    s = score_table(spark, sf).where("not (name = 'helpfulness' and cast(id as bigint) % 5 = 0)")
    return E.pending_traces(traces(spark, sf), s).select("id")


JUDGED = (f"'{E.JUDGE_PROMPT.split('{question}')[0]}' || {TRIM.format(c='q')} || '\n\nAssistant answer: ' || {TRIM.format(c='a')} || '{E.JUDGE_PROMPT.split('{answer}')[1]}'"
          .replace("assistant's", "assistant''s").replace("user's", "user''s"))


@query("e_judge_prompt", f"WITH {TRACES} SELECT id, {JUDGED} AS prompt FROM tr WHERE a IS NOT NULL AND q IS NOT NULL")
def e_judge_prompt(spark, sf):
    q = E.question_answer(traces(spark, sf)).where("answer is not null and question <> ''")
    return q.select("id", E.judge_prompt(F.col("question"), F.col("answer")).alias("prompt"))


def replies(spark, sf):
    """Judge replies with noise, missing keys, bad values and out-of-range numbers."""
    d = table(spark, sf, "documents").select("doc_id")
    i = F.col("doc_id")
    text = F.concat(F.lit('Sure:\n{"correctness": '), F.when(i % 11 == 0, F.lit('"n/a"')).otherwise((i % 150 / 100.0).cast("string")),
                    F.when(i % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(',\n "helpfulness": "'), (i % 90 / 100.0).cast("string"), F.lit('"'))),
                    F.lit(', "hallucination_free": '), F.when(i % 3 == 0, F.lit("true")).otherwise(F.lit("-0.5")), F.when(i % 13 == 0, F.lit("")).otherwise(F.lit("} thanks")))
    return d.select(i.cast("string").alias("id"), text.alias("reply"))


@query("e_score_rows", """WITH d AS (SELECT doc_id AS i FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 13 <> 0)
       SELECT i::VARCHAR AS id, name, round(value, 6)::DOUBLE AS value, 'judge' AS category_name, 'sdk' AS source FROM (
       SELECT i, 'correctness' AS name, least(1, i % 150 / 100.0) AS value FROM d UNION ALL SELECT i, 'helpfulness', i % 90 / 100.0 FROM d
       UNION ALL SELECT i, 'hallucination_free', CASE WHEN i % 3 = 0 THEN 1.0 ELSE 0.0 END FROM d)""")
def e_score_rows(spark, sf):
    return out(E.score_rows(replies(spark, sf), "proj", "why").select("id", "name", "value", "category_name", "source"))


@query("e_merge_scores", """WITH b AS (SELECT doc_id::VARCHAR AS id, doc_id % 5 AS name, doc_id / 7.0 AS value, doc_id % 4 AS version FROM documents),
       n AS (SELECT doc_id::VARCHAR AS id, doc_id % 3 AS name, doc_id / 3.0 AS value, 9 AS version FROM documents WHERE doc_id % 2 = 0)
       SELECT id, name, round(arg_max(value, version), 6)::DOUBLE AS value, max(version)::BIGINT AS version FROM (SELECT * FROM b UNION ALL SELECT * FROM n) GROUP BY ALL""")
def e_merge_scores(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    i = F.col("doc_id")
    base = d.select(i.cast("string").alias("id"), (i % 5).alias("name"), (i / 7.0).alias("value"), (i % 4).alias("version"))
    new = d.where(i % 2 == 0).select(i.cast("string").alias("id"), (i % 3).alias("name"), (i / 3.0).alias("value"), F.lit(9).cast("bigint").alias("version"))
    return out(E.merge_scores(base, new))


@query("e_trace_stats", f"""WITH {TRACES} SELECT project, count(*) AS traces, sum((conv_id % 7 = 0)::INT)::BIGINT AS errors, sum(chars)::BIGINT AS total_tokens,
       round(sum(chars) * 0.002, 4)::DOUBLE AS cost, round(avg(CASE WHEN conv_id % 4 >= 1 THEN conv_id * 3 % 100 / 100.0 END), 6)::DOUBLE AS correctness,
       round(quantile_cont(chars / 1000.0, 0.5), 5)::DOUBLE AS p50, round(quantile_cont(chars / 1000.0, 0.9), 5)::DOUBLE AS p90, round(quantile_cont(chars / 1000.0, 0.99), 5)::DOUBLE AS p99 FROM tr GROUP BY 1""")
def e_trace_stats(spark, sf):
    d = E.trace_stats(traces(spark, sf), 0.002)
    return d.select("project", "traces", "errors", "total_tokens", F.round("cost", 4).alias("cost"), F.round("correctness", 6).alias("correctness"),
                    *[F.round(c, 5).alias(c) for c in ("p50", "p90", "p99")])


@query("e_trace_trends", f"""WITH {TRACES} SELECT ((1704067200 + conv_id * 600) // 3600) * 3600 AS t, count(*) AS traces, round(avg(chars / 1000.0), 6)::DOUBLE AS mean_duration,
       sum(chars)::BIGINT AS total_tokens, round(sum(chars) * 0.002, 4)::DOUBLE AS cost, round(avg(CASE WHEN conv_id % 7 = 0 THEN 1.0 ELSE 0 END), 6) AS error_rate FROM tr GROUP BY 1""")
def e_trace_trends(spark, sf):
    d = E.trace_trends(traces(spark, sf), 3600, 0.002)
    return out(d.withColumn("cost", F.round("cost", 4)))


@query("e_spans_by_model", f"""WITH {TRACES} SELECT ((1704067200 + conv_id * 600) // 3600) * 3600 AS t, CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'm' || (conv_id % 5) END AS model, count(*) AS spans
       FROM tr GROUP BY ALL""")
def e_spans_by_model(spark, sf):
    return E.spans_by_model(traces(spark, sf), 3600)


@query("e_heuristic_vs_judge", """WITH d AS (SELECT doc_id AS i FROM documents) SELECT i::VARCHAR AS id, round(i % 10 / 10.0, 6)::DOUBLE AS heuristic, round(i % 7 / 7.0, 6)::DOUBLE AS judged,
       round(i % 10 / 10.0 - i % 7 / 7.0, 6)::DOUBLE AS difference FROM d WHERE i % 4 <> 0""")
def e_heuristic_vs_judge(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    s = d.select(i.cast("string").alias("id"), F.lit("hallucination_quality").alias("name"), (i % 10 / 10.0).alias("value")).unionByName(
        d.where(i % 4 != 0).select(i.cast("string").alias("id"), F.lit("hallucination_free").alias("name"), (i % 7 / 7.0).alias("value")))
    return out(E.heuristic_vs_judge(s))


@query("e_reconcile_traces", """WITH a AS (SELECT event_id AS rid, user_id AS tokens, value AS duration FROM events WHERE event_id % 5 <> 0),
       b AS (SELECT event_id AS rid, user_id + (event_id % 9 = 0)::INT AS tokens, value + 0.01 * (event_id % 4) AS duration FROM events WHERE event_id % 7 <> 0)
       SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.rid IS NULL THEN 'only_a' WHEN a.rid IS NULL THEN 'only_b'
       WHEN a.tokens = b.tokens AND abs(a.duration - b.duration) <= 0.0155 THEN 'matched' ELSE 'differs' END AS status FROM a FULL JOIN b USING (rid)) GROUP BY 1""")
def e_reconcile_traces(spark, sf):
    d = events(spark, sf)
    i = F.col("event_id")
    a = d.where(i % 5 != 0).select(i.alias("rid"), F.col("user_id").alias("tokens"), F.col("value").alias("duration"))
    b = d.where(i % 7 != 0).select(i.alias("rid"), (F.col("user_id") + (i % 9 == 0).cast("int")).alias("tokens"), (F.col("value") + 0.01 * (i % 4)).alias("duration"))
    return E.reconcile_traces(a, b, "rid", 0.0155).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- benchmark results: lineitem rows as requests ----

def results(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select(
        F.col("l_linenumber").alias("level"), (F.col("l_returnflag") != "R").alias("ok"), (F.col("l_discount") + F.col("l_tax")).alias("ttft"),
        (F.col("l_extendedprice") / 1000).alias("total"), F.col("l_quantity").alias("tps"), F.col("l_partkey").alias("comp_tokens"),
        F.col("l_suppkey").alias("prompt_tokens"), F.col("l_orderkey"), instant_of("l_shipdate").alias("ts"))


RES = """rs AS (SELECT l_linenumber AS level, l_returnflag <> 'R' AS ok, l_discount + l_tax AS ttft, l_extendedprice / 1000 AS total, l_quantity AS tps,
       l_partkey AS comp_tokens, l_suppkey AS prompt_tokens, l_orderkey, l_shipdate FROM lineitem)"""


def nr(col: str, p: int) -> str:
    return f"list_sort(list({col}) FILTER (ok))[least(count(*) FILTER (ok) - 1, CAST(floor({p / 100!r}::DOUBLE * count(*) FILTER (ok)) AS BIGINT)) + 1]"


@query("b_bench_summary", f"""WITH {RES} SELECT level, count(*) AS requests, sum((NOT ok)::INT)::BIGINT AS errors, round(sum((NOT ok)::INT) / count(*), 4)::DOUBLE AS error_rate,
       {', '.join(f"round({nr(c, p)}, 6) AS {c}_p{p}" for c, ps in (('ttft', (50, 95, 99)), ('total', (50, 95)), ('tps', (50, 95))) for p in ps)},
       round(sum(comp_tokens) FILTER (ok) / max(total), 1)::DOUBLE AS throughput_tok_s, round(max(total), 1) AS wall_s FROM rs GROUP BY level""")
def b_bench_summary(spark, sf):
    return out(B.bench_summary(results(spark, sf), ["level"]))


@query("a_nearest_rank", f"""WITH {RES} SELECT level, ok, round(list_sort(list(total))[least(count(*) - 1, CAST(floor(0.9::DOUBLE * count(*)) AS BIGINT)) + 1], 6) AS p90 FROM rs GROUP BY ALL""")
def a_nearest_rank(spark, sf):
    return out(ST.nearest_rank(results(spark, sf), ["level", "ok"], "total", {"p90": 90}))


@query("a_p95_minus_one", f"WITH {RES} SELECT level, round(list_sort(list(total))[CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT)], 6) AS p95 FROM rs GROUP BY ALL")
def a_p95_minus_one(spark, sf):
    return out(ST.p95_minus_one(results(spark, sf), ["level"], "total"))


@query("a_percentiles", f"WITH {RES} SELECT ok, round(quantile_cont(total, 0.25), 6) AS q25, round(quantile_cont(total, 0.999), 6) AS q999 FROM rs GROUP BY ALL")
def a_percentiles(spark, sf):
    return out(ST.percentiles(results(spark, sf), ["ok"], "total", {"q25": 0.25, "q999": 0.999}))


@query("a_moments", f"""WITH {RES} SELECT level, count(*) AS n, round(avg(total), 6) AS mean, round(stddev_pop(total), 6) AS pstdev, round(stddev_samp(total), 6) AS stdev,
       round(min(total), 6) AS min, round(max(total), 6) AS max FROM rs GROUP BY ALL""")
def a_moments(spark, sf):
    return out(ST.moments(results(spark, sf), ["level"], "total"))


@query("a_distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS n_user_id FROM events GROUP BY 1")
def a_distinct_counts(spark, sf):
    return ST.distinct_counts(events(spark, sf), ["event_type"], ["user_id"])


@query("b_scenario_summary", f"""WITH {RES} SELECT level, round(avg(ttft), 6) AS ttft_mean, round(stddev_pop(ttft), 6) AS ttft_pstdev, round(avg(total), 6) AS total_mean,
       round(stddev_pop(total), 6) AS total_pstdev, round(avg(tps), 6) AS tps_mean, round(avg(comp_tokens), 4) AS comp_tokens_mean FROM rs GROUP BY ALL""")
def b_scenario_summary(spark, sf):
    d = B.scenario_summary(results(spark, sf), ["level"]).drop("prompt_tokens_mean")
    return out(d.withColumn("comp_tokens_mean", F.round("comp_tokens_mean", 4)))


@query("b_burst_summary", f"""WITH {RES} SELECT level, count(*) AS requests, round(sum(total) / 4, 3) AS wall, round(avg(total), 6) AS mean_latency,
       round(list_sort(list(total))[CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT)], 6) AS p95, round(sum(comp_tokens) / (sum(total) / 4), 4)::DOUBLE AS throughput FROM rs GROUP BY ALL""")
def b_burst_summary(spark, sf):
    d = B.burst_summary(results(spark, sf), F.sum("total") / 4, ["level"])
    return out(d.withColumns({"wall": F.round("wall", 3), "throughput": F.round("throughput", 4)}))


@query("b_result_columns", f"""WITH {EV} SELECT event_id, round(gen * 1.00013, 9) AS total, round(greatest(1e-9, gen * 1.00013 - CASE WHEN k % 5 = 0 THEN 0 ELSE gen / 3 END), 9) AS gen_time,
       CASE WHEN k % 3 = 0 THEN 2 WHEN k = 0 THEN 2 ELSE k END AS comp_tokens, CASE WHEN k % 4 = 0 THEN greatest(1, length(event_type) // 3) ELSE k END::BIGINT AS prompt_tokens FROM ev""")
def b_result_columns(spark, sf):
    k = F.col("k")
    d = events(spark, sf).select(
        "event_id", F.lit(0.0).alias("t_send"), (F.col("gen") * 1.00013).alias("t_done"), F.when(k % 5 != 0, F.col("gen") / 3).alias("ttft"),
        F.when(k % 3 != 0, k).alias("usage_completion"), F.when(k % 4 != 0, k).alias("usage_prompt"), F.lit("two words").alias("content"), F.col("event_type").alias("prompt"))
    r = B.result_columns(d)
    return r.select("event_id", F.round("total", 9).alias("total"), F.round("gen_time", 9).alias("gen_time"), "comp_tokens", "prompt_tokens")


@query("b_sweep_compare", f"""WITH {RES}, a AS (SELECT level, avg(total) AS v FROM rs WHERE ok GROUP BY 1), b AS (SELECT level, avg(total) * (level + 1) AS v FROM rs WHERE NOT ok GROUP BY 1)
       SELECT level, round(a.v, 6) AS a, round(b.v, 6) AS b, round(b.v / a.v, 6) AS ratio, a.v = max(a.v) OVER () AS peak_a, b.v = max(b.v) OVER () AS peak_b FROM a JOIN b USING (level)""")
def b_sweep_compare(spark, sf):
    r = results(spark, sf)
    a = r.where("ok").groupBy("level").agg(F.avg("total").alias("v"))
    b = r.where("not ok").groupBy("level").agg((F.avg("total") * (F.col("level") + 1)).alias("v"))
    return out(B.sweep_compare(a, b, "level", "v"))


def agent_turns(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.length("text") % 4
    call = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("f").alias("name"), F.when((F.length("text") + i) % 3 == 0, "{bad").otherwise('{"a": 1}').alias("arguments")))
    return c.select(F.col("conv_id").alias("run_id"), F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("scenario"), "turn",
                    F.when(F.length("text") % 5 != 0, F.length("text") / 1000).alias("ttft"), (F.length("text") / 500).alias("wall"),
                    F.when(n > 0, call).alias("tool_calls"))


AGENT = """tn AS (SELECT conv_id AS run_id, 's' || (conv_id % 3) AS scenario, CASE WHEN length(text) % 5 <> 0 THEN length(text) / 1000.0 END AS ttft, length(text) / 500.0 AS wall,
       length(text) % 4 AS n, len(list_filter(range(1, length(text) % 4 + 1), lambda i: (length(text) + i) % 3 <> 0)) AS v FROM conversations),
       rn AS (SELECT run_id, scenario, count(*) AS turns, sum(n)::BIGINT AS calls, sum(v)::BIGINT AS valid_calls, bool_or(n = 0) AS done, avg(ttft) AS ttft_mean, max(ttft) AS ttft_max,
       avg(wall) AS turn_wall_mean, sum(wall) AS wall FROM tn GROUP BY ALL)"""


@query("b_agent_runs", f"""WITH {AGENT} SELECT run_id, scenario, turns, calls, valid_calls, done, round(ttft_mean, 6)::DOUBLE AS ttft_mean, round(ttft_max, 6)::DOUBLE AS ttft_max,
       round(turn_wall_mean, 6)::DOUBLE AS turn_wall_mean, round(wall, 6)::DOUBLE AS wall FROM rn""")
def b_agent_runs(spark, sf):
    return out(B.agent_runs(agent_turns(spark, sf)))


@query("b_agent_summary", f"""WITH {AGENT} SELECT scenario, count(*) AS completed, sum(done::INT)::BIGINT AS done_in_budget, round(avg(turns), 6) AS turns_mean, round(avg(calls), 6) AS calls_mean,
       round(sum(valid_calls) / sum(calls), 6)::DOUBLE AS valid_rate, round(avg(ttft_mean), 6)::DOUBLE AS ttft_mean, round(max(ttft_max), 6)::DOUBLE AS ttft_max, round(avg(wall), 6)::DOUBLE AS wall_mean FROM rn GROUP BY 1""")
def b_agent_summary(spark, sf):
    return out(B.agent_summary(B.agent_runs(agent_turns(spark, sf))))


# ---- as-of and interval joins ----

def snaps(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 4).alias("grp"), instant_of("o_orderdate").alias("ts"), F.col("o_totalprice").alias("gpu_mem"), F.col("o_orderkey")).groupBy("grp", "ts").agg(
        F.max("gpu_mem").alias("gpu_mem"))


@query("j_asof_snapshot", """WITH s AS (SELECT o_custkey % 4 AS grp, o_orderdate AS ts, max(o_totalprice) AS gpu_mem FROM orders GROUP BY ALL),
       r AS (SELECT l_suppkey % 4 AS grp, l_shipdate AS ts, l_orderkey, l_linenumber FROM lineitem)
       SELECT r.grp, r.l_orderkey, r.l_linenumber, epoch_us(s.ts) // 1000000 AS snapshot_t, round(s.gpu_mem, 2) AS gpu_mem FROM r ASOF LEFT JOIN s ON r.grp = s.grp AND r.ts >= s.ts""")
def j_asof_snapshot(spark, sf):
    r = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("grp"), instant_of("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber")
    j = B.asof_snapshot(r, snaps(spark, sf), ["grp"], ["gpu_mem"], slice_seconds=30 * 86400)
    return j.select("grp", "l_orderkey", "l_linenumber", F.unix_seconds("snapshot_ts").alias("snapshot_t"), F.round("gpu_mem", 2).alias("gpu_mem"))


@query("b_snapshot_stats", """WITH s AS (SELECT o_custkey % 4 AS grp, o_orderdate AS ts, max(o_totalprice) AS gpu_mem FROM orders GROUP BY ALL),
       r AS (SELECT l_suppkey % 4 AS grp, l_shipdate AS ts, l_linenumber AS level FROM lineitem)
       SELECT level, count(*) AS requests, count(s.ts) AS with_snapshot, round(avg(s.gpu_mem), 4) AS gpu_mem_mean FROM r ASOF LEFT JOIN s ON r.grp = s.grp AND r.ts >= s.ts GROUP BY 1""")
def b_snapshot_stats(spark, sf):
    r = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("grp"), instant_of("l_shipdate").alias("ts"), F.col("l_linenumber").alias("level"))
    return out(B.snapshot_stats(r, snaps(spark, sf), ["grp"], ["level"], ["gpu_mem"]), 4)


@query("j_crash_request_join", f"""WITH {EV} SELECT c.event_id AS crash_id, r.event_id AS request_id FROM ev c JOIN ev r
       ON c.us >= r.us AND c.us <= r.us + r.cents * 100000 + 60000000 WHERE c.event_type = 'error'""")
def j_crash_request_join(spark, sf):
    d = events(spark, sf)
    c = d.where("event_type = 'error'").select(F.col("event_id").alias("crash_id"), F.col("ts").alias("crash_ts"))
    r = d.select(F.col("event_id").alias("request_id"), F.col("ts").alias("start_ts"), F.timestamp_micros(F.col("us") + F.col("cents") * 100000).alias("end_ts"))
    return B.crash_request_join(c, r, 60, 1200).select("crash_id", "request_id")


@query("o_latest_n", "SELECT event_id, epoch_us(ts) AS us FROM events ORDER BY ts DESC, event_id LIMIT 20")
def o_latest_n(spark, sf):
    return ST.latest_n(events(spark, sf), "ts", 20, ["event_id"]).select("event_id", "us")


@query("o_lowest_k", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 8")
def o_lowest_k(spark, sf):
    return ST.lowest_k(events(spark, sf).select("event_id", "value"), "value", 8, ["event_id"])


PROVIDERS = {"m0": "own", "m1": "vllm", "m2": "sglang"}


def engine_samples(spark, sf):
    """Each model is served by an engine of its own, which reports under its own metric names and a provider label."""
    d, parts = calls(spark, sf), []
    for i, (model, provider) in enumerate(PROVIDERS.items()):
        x = d.where(F.col("model") == model)

        def add(record, labels, value, rows, i=i, provider=provider):
            if record == "up" or i < len(B.ENGINE_METRICS[record]):
                name, ours = ("up", False) if record == "up" else B.ENGINE_METRICS[record][i]
                parts.append(_sample(rows, N.m(name) if ours else name, {**labels, "provider": provider}, value, own=False)[1])

        def running(rows, amount, by=()):
            return F.sum(amount).over(Window.partitionBy(*by, "day").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))

        add("tokens_generated_rate1m", {}, F.col("v"), x.withColumn("v", running(x, F.col("k"))))
        add("ttft_p95", {"le": F.col("le")}, F.col("value"), bucket_counts(x, "ttft", BOUNDS["ttft_seconds"], []))
        add("requests_running", {}, F.col("k") % 12, x)
        add("kv_cache_usage_ratio", {}, F.col("k") / 100, x)
        # Only calls that were broken off count as errors, where the metric tells.
        bad = x.withColumn("why", F.when(F.col("status") >= 400, "abort").otherwise("stop"))
        bad = bad if i else bad.where("why = 'abort'")
        add("errors_rate5m", {"finished_reason": F.col("why")} if i else {}, F.col("v"), bad.withColumn("v", running(bad, F.lit(1), ["why"])))
        add("up", {"job": provider}, F.when(F.col("k") > 5, 1).otherwise(0), x)
    return reduce(DataFrame.unionByName, parts)


PROVIDER = "CASE model WHEN 'm0' THEN 'own' WHEN 'm1' THEN 'vllm' ELSE 'sglang' END AS provider"


def _gauge_sql(value: str, ago: int = 300) -> str:
    return f"SELECT g.t AS t, i.model AS model, arg_max({value}, i.us) AS value FROM grid g JOIN ev i ON i.us > (g.t - {ago}) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL"


ENGINES = " UNION ALL ".join(f"SELECT '{record}' AS record, t, {PROVIDER}, round(value, 6)::DOUBLE AS value FROM ({sql})" for record, sql in {
    "tokens_generated_rate1m": f"SELECT t, model, value / 60.0 AS value FROM ({window_sum('tk', 60, ['model'])})",
    "ttft_p95": quantile_sql(0.95, f"({window_sum('bk', 300, ['model', 'le', 'bound'])})", ["model"]),
    "requests_running": _gauge_sql("i.k % 12"), "kv_cache_usage_ratio": _gauge_sql("i.k / 100"),
    "errors_rate5m": f"SELECT t, model, value / 300.0 AS value FROM ({window_sum('br', 300, ['model'])}) WHERE model <> 'm2'",
    "up": _gauge_sql("CASE WHEN i.k > 5 THEN 1 ELSE 0 END")}.items())


@query("n_normalize_engines", f"""WITH {FAST_EV}, {grid_cte(GRID)}, {call_increments('tk', ['model'], 'k')}, {call_increments('br', ['model'], '1', 'status >= 400')},
       {bucket_increments('bk', 'ttft', BOUNDS['ttft_seconds'], ['model'])} SELECT * FROM ({ENGINES}) WHERE value IS NOT NULL""")
def n_normalize_engines(spark, sf):
    dealt_ = dealt(engine_samples(spark, sf), "metric", F.pmod(F.xxhash64("ts"), F.lit(64)))
    samples = saved(dealt_, "engines", ("metric",))  # each record prunes to its metrics
    return out(B.normalize_engines(samples, GRID, N.metric))

"""Requests, streamed responses, text heuristics and token confidence."""

from pyspark.sql import functions as F

from servelens.functions import text as Q
from servelens.operators import requests as R
from servelens.sources.readers import fill_cores

from .adapters import EV, T0, events, out, table
from .registry import query

ROUND = 6


def request_rows(spark, sf):
    """Raw request/response records built from ``events`` joined by nothing: JSON text per call."""
    d = fill_cores(events(spark, sf), "event_id")
    text = F.concat(F.lit("value "), F.col("cents").cast("string"), F.lit(" maybe likely "), F.col("event_type"))
    body = F.to_json(F.struct(
        F.when(F.col("k") % 10 != 0, F.col("model")).alias("model"), (F.col("event_id") % 2 == 0).alias("stream"),
        F.when(F.col("k") % 5 != 0, F.col("k") / 100).alias("temperature"),
        F.when(F.col("k") % 3 == 0, F.array(F.struct(F.lit("function").alias("type")))).alias("tools"),
        F.array(F.struct(F.lit("user").alias("role"), F.concat_ws(" ", F.col("event_type"), F.col("node"), F.lit("ask")).alias("content"))).alias("messages"),
        (F.col("kind") == "reasoning").alias("enable_thinking"), F.when(F.col("k") % 7 == 0, True).alias("logprobs")))
    call = F.struct(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"),
                    F.when(F.col("k") % 2 == 0, "function").alias("type"),
                    F.struct(F.when(F.col("k") % 9 != 0, F.concat(F.lit("tool"), (F.col("k") % 5).cast("string"))).alias("name"),
                             F.lit("{}").alias("arguments")).alias("function"))
    resp = F.to_json(F.struct(
        F.array(F.struct(F.lit(0).alias("index"), F.when(F.col("k") % 6 != 0, F.lit("stop")).alias("finish_reason"),
                         F.struct(F.lit("assistant").alias("role"), text.alias("content"),
                                  F.when(F.col("k") % 6 == 0, F.array(call)).alias("tool_calls")).alias("message"))).alias("choices"),
        F.when(F.col("k") % 4 != 0, F.struct(
            F.col("k").alias("prompt_tokens"), (F.col("k") % 50).alias("completion_tokens"),
            F.struct((F.col("k") * 2 % 120).alias("cached_tokens")).alias("prompt_tokens_details"))).alias("usage")))
    sec = (F.col("us") - T0 * 1_000_000) / 1e6
    path = F.when(F.col("event_type") == "view", "/v1/models").otherwise("/v1/chat/completions")
    return d.select(
        F.col("event_id").cast("string").alias("request_id"), F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        path.alias("path"), F.create_map(F.lit("X-Mlx-Trace"), F.when(F.col("k") % 8 == 0, "0").otherwise("1")).alias("headers"),
        body.alias("body"), F.col("status"), resp.alias("response"), (sec - F.col("k") / 1000).alias("t_arrival"), sec.alias("t_send"),
        F.when(F.col("k") % 2 == 0, sec + F.col("gen") / 3).alias("t_first"), (sec + F.col("gen") * 1.00013).alias("t_done"))


FACTS = EV + """, rq AS (SELECT *, CASE WHEN k % 10 != 0 THEN model ELSE 'default' END AS mdl,
       CASE WHEN k % 4 != 0 THEN k ELSE 3 END AS prompt_tokens,
       CASE WHEN k % 4 != 0 THEN k % 50 ELSE 5 END AS completion_tokens, epoch_us(CAST(NULL AS TIMESTAMP)) AS z
       FROM ev WHERE event_type <> 'view')"""


def facts(spark, sf, parsed=None):
    d = (R.parse_responses(R.parse_requests(request_rows(spark, sf))) if parsed is None else parsed).drop("logprobs")
    models = table(spark, sf, "nation").select(
        F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("model"), (F.col("n_nationkey") * 40 + 20).alias("max_context"))
    return R.request_facts(d, models)


@query("r_request_facts", f"""WITH {FACTS} SELECT event_id::VARCHAR AS request_id, mdl AS model, kind, event_id % 2 = 0 AS streaming,
       round(CASE WHEN k % 5 != 0 THEN k / 100 ELSE 0 END, 6) AS temperature, prompt_tokens, completion_tokens,
       CASE WHEN k % 4 != 0 THEN k * 2 % 120 ELSE 0 END AS cached_tokens,
       round(CASE WHEN k % 4 != 0 AND k > 0 THEN least(1, (k * 2 % 120) / k) END, 6) AS cache_ratio,
       round(gen * 1.00013, 4) AS gen_seconds, round(CASE WHEN k % 2 = 0 THEN gen / 3 ELSE gen * 1.00013 END, 4) AS ttft_seconds,
       round(CASE WHEN completion_tokens > 0 THEN completion_tokens / (gen * 1.00013) END, 2) AS token_rate,
       CASE WHEN status >= 400 THEN (status // 100)::VARCHAR || 'xx' END AS error_class,
       CASE WHEN k % 6 != 0 THEN 'stop' ELSE 'unknown' END AS finish_reason, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS n_tool_calls,
       round(least(1, 0.4 * least(2 / 5.0, 1) + 0.7 * CASE WHEN k % 3 = 0 AND k % 6 != 0 THEN 1 ELSE 0 END), 6) AS risk,
       round(CASE WHEN mdl <> 'default' THEN least(1.0, (prompt_tokens + completion_tokens) / (substr(mdl, 2)::INTEGER * 40 + 20)) END, 6) AS context_utilization
       FROM rq""")
def r_request_facts(spark, sf, parsed=None):
    d = facts(spark, sf, parsed)
    return d.select(
        "request_id", "model", "kind", "streaming", F.round("temperature", 6).alias("temperature"), "prompt_tokens", "completion_tokens",
        "cached_tokens", F.round("cache_ratio", 6).alias("cache_ratio"), F.round("gen_seconds", 4).alias("gen_seconds"),
        F.round("ttft_seconds", 4).alias("ttft_seconds"), F.round("token_rate", 2).alias("token_rate"), "error_class", "finish_reason",
        "n_tool_calls", F.round("risk", 6).alias("risk"), F.round("context_utilization", 6).alias("context_utilization"))


@query("p_completions_only", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def p_completions_only(spark, sf):
    d = R.completions_only(request_rows(spark, sf).join(events(spark, sf).select(
        F.col("event_id").cast("string").alias("request_id"), "event_type"), "request_id"))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("p_traced_only", f"WITH {EV} SELECT CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, count(*) AS n FROM ev WHERE k % 8 <> 0 GROUP BY 1")
def p_traced_only(spark, sf):
    return R.traced_only(request_rows(spark, sf)).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("r_tool_calls", f"""WITH {FACTS} SELECT mdl AS model, kind, CASE WHEN k % 9 != 0 THEN 'tool' || (k % 5)::VARCHAR ELSE 'function' END AS tool,
       'function' AS type, count(*) AS value FROM rq WHERE k % 6 = 0 GROUP BY ALL""")
def r_tool_calls(spark, sf):
    t = R.explode_tool_calls(facts(spark, sf), ["model", "kind"])
    return R.count_by_labels(t, ["model", "kind", "tool", "type"])


@query("a_count_by_labels", f"""WITH {FACTS} SELECT mdl AS model, kind, finish_reason, count(*) AS n, sum(completion_tokens)::BIGINT AS tokens FROM (
       SELECT *, CASE WHEN k % 6 != 0 THEN 'stop' ELSE 'unknown' END AS finish_reason FROM rq) GROUP BY ALL""")
def a_count_by_labels(spark, sf):
    f = facts(spark, sf)
    key = ["model", "kind", "finish_reason"]
    n = R.count_by_labels(f, key).withColumnRenamed("value", "n")
    return n.join(R.count_by_labels(f, key, "completion_tokens").withColumnRenamed("value", "tokens"), key)


@query("a_latest_gauge", f"""WITH {FACTS} SELECT mdl AS model, kind, round(arg_max(CASE WHEN k % 5 != 0 THEN k / 100 ELSE 0 END, (us, event_id)), 6) AS value
       FROM rq GROUP BY ALL""")
def a_latest_gauge(spark, sf):
    f = facts(spark, sf).withColumn("id", F.col("request_id").cast("bigint"))
    return out(R.latest_gauge(f, ["model", "kind"], "temperature", "t_send", "id"))


@query("r_error_counts", f"""WITH {EV} SELECT (status // 100)::VARCHAR || 'xx' AS status, kind, count(*) AS value FROM ev WHERE status >= 400 GROUP BY ALL""")
def r_error_counts(spark, sf):
    d = R.parse_requests(request_rows(spark, sf)).withColumn("status", R.status_class(F.col("status"))).where("status is not null")
    return R.count_by_labels(d, ["status", "kind"])


@query("r_scoring_plan", f"""WITH {EV} SELECT src AS lp_source, count(*) AS n FROM (SELECT CASE WHEN k % 7 = 0 THEN
       CASE WHEN event_id % 2 = 0 THEN '' ELSE 'client' END WHEN event_id % 2 = 1 THEN 'injected' ELSE 'destreamed' END AS src FROM ev) GROUP BY 1""")
def r_scoring_plan(spark, sf):
    d = R.parse_requests(request_rows(spark, sf), top=5, sample=1.0)
    return d.groupBy("lp_source").agg(F.count(F.lit(1)).alias("n"))


@query("r_scoring_coverage", f"""WITH {EV}, s AS (SELECT model, CASE WHEN k % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN '' ELSE 'client' END
       WHEN event_id % 2 = 1 THEN 'injected' ELSE '' END AS src FROM (SELECT * REPLACE (CASE WHEN k % 10 != 0 THEN model ELSE 'default' END AS model) FROM ev))
       SELECT model, src AS lp_source, count(*) AS scored, any_value(total) AS requests, round(100.0 * count(*) / greatest(any_value(total), 1), 6) AS coverage
       FROM (SELECT *, count(*) OVER (PARTITION BY model) AS total FROM s) WHERE src <> '' GROUP BY ALL""")
def r_scoring_coverage(spark, sf):
    return out(R.scoring_coverage(R.parse_requests(request_rows(spark, sf), top=5, sample=0.0), ["model"]))


@query("r_zero_completion_share", f"""WITH {EV} SELECT model, count(*) AS requests, round(avg(CASE WHEN k % 50 = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share,
       round(avg(CASE WHEN k % 50 = 0 AND k % 2 = 1 THEN 1.0 ELSE 0 END), 6) AS dead_stream_share FROM ev GROUP BY ALL""")
def r_zero_completion_share(spark, sf):
    d = events(spark, sf).select(
        "model", (F.col("k") % 50).alias("completion_tokens"), F.when(F.col("k") % 50 != 0, "x").otherwise("").alias("content"),
        F.col("gen").alias("gen_seconds"), F.when(F.col("k") % 2 == 1, F.col("gen")).otherwise(F.col("gen") / 2).alias("ttft_seconds"))
    return out(R.zero_completion_share(d, ["model"]))


@query("x_concurrency_timeline", f"""WITH {EV}, e AS (SELECT model, event_id, us, 1 AS delta FROM ev UNION ALL
       SELECT model, event_id, us + cents * 10000, -1 FROM ev)
       SELECT model, event_id, us, delta, CAST(sum(delta) OVER (PARTITION BY model ORDER BY us, delta, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS in_flight FROM e""")
def x_concurrency_timeline(spark, sf):
    d = events(spark, sf).withColumn("done", F.timestamp_micros(F.col("us") + F.col("cents") * 10000))
    t = R.concurrency_timeline(d, "ts", "done", ["model"], "event_id", slice_seconds=21600)
    return t.select("model", "event_id", F.unix_micros("ts").alias("us"), "delta", "in_flight")


def chunks(spark, sf):
    """Streamed chunks: the words of each assistant turn, one chunk each, then usage and [DONE]."""
    c = fill_cores(table(spark, sf, "conversations"), "conv_id").where("role = 'assistant'").withColumn("rid", F.concat_ws("-", "conv_id", "turn"))
    words = F.split("text", " ")
    base = c.select("rid", "conv_id", "turn", words.alias("w"))
    d = base.select("rid", "turn", F.posexplode("w").alias("seq", "word"), F.size("w").alias("n"))
    tool = F.when((F.col("turn") % 4 == 3) & (F.col("seq") < 2), F.array(F.struct(
        F.when(F.col("n") % 5 != 0, F.lit("call_1")).alias("id"), F.when(F.col("seq") == 0, "function").alias("type"),
        F.struct(F.concat(F.lit("part"), F.col("seq").cast("string")).alias("name"), F.lit("{").alias("arguments")).alias("function"))))
    body = F.to_json(F.struct(F.array(F.struct(
        F.when(F.col("seq") == F.col("n") - 1, F.lit("stop")).alias("finish_reason"),
        F.struct(F.concat(F.col("word"), F.lit(" ")).alias("content"), tool.alias("tool_calls")).alias("delta"))).alias("choices")))
    ends = base.select("rid", F.explode(F.array(
        F.struct((F.size("w") + 1).alias("seq"), F.concat(F.lit('data: {"choices": [], "usage": {"prompt_tokens": 5, "completion_tokens": '),
                                                          F.size("w").cast("string"), F.lit("}}")).alias("p")),
        F.struct((F.size("w") + 2).alias("seq"), F.lit("data: [DONE]").alias("p")),
        F.struct((F.size("w") + 3).alias("seq"), F.lit("data: {broken").alias("p")))).alias("x"))
    both = d.select("rid", "seq", F.concat(F.lit("data: "), body).alias("payload")).unionByName(
        ends.select("rid", F.col("x.seq").alias("seq"), F.col("x.p").alias("payload")))
    return both.select(F.col("rid").alias("request_id"), F.col("seq").cast("bigint").alias("seq"),
                       F.timestamp_micros(F.col("seq") * 1000 + T0 * 1_000_000).alias("recv_ts"), "payload")


@query("r_assemble_stream", """SELECT conv_id || '-' || turn AS request_id, text || ' ' AS content,
       len(string_split(text, ' '))::BIGINT AS completion_tokens, 'stop' AS finish_reason,
       CASE WHEN turn % 4 = 3 AND len(string_split(text, ' ')) % 5 <> 0 THEN
         CASE WHEN len(string_split(text, ' ')) > 1 THEN 'part0part1:function' ELSE 'part0:function' END ELSE '' END AS tools
       FROM conversations WHERE role = 'assistant'""")
def r_assemble_stream(spark, sf):
    d = R.stream_completion_tokens(R.assemble_stream(chunks(spark, sf)))
    return d.select("request_id", "content", "completion_tokens", "finish_reason",
                    F.array_join(F.transform("tools", lambda t: F.concat_ws(":", t["name"], t["type"])), ",").alias("tools"))


@query("r_assemble_tool_args", """SELECT conv_id || '-' || turn AS request_id, 0 AS "index",
       CASE WHEN len(string_split(text, ' ')) > 1 THEN 'part0part1' ELSE 'part0' END AS name,
       CASE WHEN len(string_split(text, ' ')) > 1 THEN '{{' ELSE '{' END AS arguments FROM conversations WHERE role = 'assistant' AND turn % 4 = 3""")
def r_assemble_tool_args(spark, sf):
    return R.assemble_tool_args(chunks(spark, sf))


@query("r_first_token_time", """SELECT conv_id || '-' || turn AS request_id, (1704067200000000)::BIGINT AS us FROM conversations WHERE role = 'assistant'""")
def r_first_token_time(spark, sf):
    return R.first_token_time(chunks(spark, sf)).select("request_id", F.unix_micros("t_first").alias("us"))


@query("p_strip_logprobs", f"""WITH {EV} SELECT k % 2 = 0 AS removed, count(*) AS n, 2::BIGINT AS fields FROM ev GROUP BY ALL""")
def p_strip_logprobs(spark, sf):
    d = events(spark, sf)
    lp = F.when(F.col("k") % 2 == 0, F.struct(F.array(F.struct(F.lit("a").alias("token"))).alias("content")))
    resp = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.col("event_type").alias("finish_reason"),
                                               lp.alias("logprobs"))).alias("choices")))
    s = R.strip_logprobs(d.select(resp.alias("response")))
    return s.groupBy(F.col("logprobs_removed").alias("removed"), F.size(F.element_at("choices", 1)).cast("bigint").alias("fields")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- text heuristics over whole documents and assistant turns ----

STOP = ", ".join(f"'{w}'" for w in Q.STOPWORDS)
SPACE = Q.SPACE
WORDS = f"""w AS (SELECT id, text, list_filter(list_transform(regexp_split_to_array(text, '{SPACE}+'),
       lambda x: lower(trim(x, '.,!?;:()"''')) ), lambda x: x <> '' AND x NOT IN ({STOP})) AS ws FROM src)"""
REP = """, g AS (SELECT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram
       FROM w WHERE len(ws) >= 9), c AS (SELECT id, gram, count(*) AS n FROM g GROUP BY ALL),
       rep AS (SELECT id, max(n)::DOUBLE / sum(n) AS r FROM c GROUP BY id)"""
HEDGE = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{h}', ''))) // {len(h)}" for h in Q.HEDGES)
REFUSAL = Q.REFUSAL.replace("'", "''")
SCORES = f"""round(coalesce(rep.r, 0), 6) AS repetition,
       CASE WHEN regexp_matches(text, '{REFUSAL}', 'i') THEN 1.0 ELSE 0.0 END::DOUBLE AS refusal,
       round(least(({HEDGE}) / 5.0, 1.0), 6) AS hedging, CASE WHEN regexp_matches(text, '\\d') THEN 1.0 ELSE 0.0 END::DOUBLE AS ungrounded"""


def scored(d):
    t = F.col("text")
    return d.select(
        "id", F.round(Q.repetition(t), 6).alias("repetition"), Q.refusal(t).alias("refusal"), F.round(Q.hedging(t), 6).alias("hedging"),
        Q.ungrounded(t, F.lit(True), F.lit(0)).alias("ungrounded"))


@query("q_text_scores_documents", f"WITH src AS (SELECT doc_id AS id, text FROM documents), {WORDS}{REP} SELECT w.id, {SCORES} FROM w LEFT JOIN rep USING (id)")
def q_text_scores_documents(spark, sf):
    return scored(fill_cores(table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "text"))


@query("q_text_scores_turns", f"""WITH src AS (SELECT conv_id * 100 + turn AS id, text FROM conversations WHERE role = 'assistant'), {WORDS}{REP}
       SELECT w.id, {SCORES} FROM w LEFT JOIN rep USING (id)""")
def q_text_scores_turns(spark, sf):
    return scored(table(spark, sf, "conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"))


def doc_facts(spark, sf):
    d = fill_cores(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("request_id"), F.col("lang").alias("model"), F.col("text").alias("content"),
        (F.col("doc_id") % 2 == 0).alias("tools_provided"), F.lit(0).alias("n_tool_calls"))
    return R.score_text(d)


RISK = f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {WORDS}{REP}, s AS (SELECT w.id, {SCORES} FROM w LEFT JOIN rep USING (id)),
       r AS (SELECT id, least(1.0, 0.5 * repetition + 0.25 * refusal + 0.4 * hedging + 0.7 * CASE WHEN id % 2 = 0 THEN ungrounded ELSE 0 END) AS risk FROM s)"""


@query("q_risk_by_lang", RISK + """ SELECT lang, count(*) AS n, round(avg(risk), 4) AS mean_risk, sum(CASE WHEN risk > 0.5 THEN 1 ELSE 0 END)::BIGINT AS flagged
       FROM r JOIN documents d ON d.doc_id = r.id GROUP BY 1""")
def q_risk_by_lang(spark, sf):
    return doc_facts(spark, sf).groupBy(F.col("model").alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("risk"), 4).alias("mean_risk"), F.sum(F.col("flagged").cast("int")).alias("flagged"))


@query("q_feedback_scores", RISK + """ SELECT name, category_name, count(*) AS n, round(avg(value), 3) AS mean FROM (
       SELECT 'hallucination_quality' AS name, 'quality' AS category_name, round(1 - risk, 3) AS value FROM r UNION ALL
       SELECT 'hallucination_flagged', 'safety', CASE WHEN risk > 0.5 THEN 0.0 ELSE 1.0 END FROM r) GROUP BY ALL""")
def q_feedback_scores(spark, sf):
    return R.feedback_scores(doc_facts(spark, sf), with_confidence=False).groupBy("name", "category_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("mean"))


# ---- token confidence over embeddings read as log-probabilities ----

def logprob_rows(spark, sf):
    e = fill_cores(table(spark, sf, "embeddings"), "vec_id")
    lp = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    top = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: F.struct(
        F.lit("t").alias("token"), F.element_at(F.col("lp"), i).alias("logprob"),
        F.transform(F.slice(F.col("lp"), i, F.lit(4)), lambda c: F.struct(F.lit("c").alias("token"), c.alias("logprob"))).alias("top_logprobs")))
    return e.withColumn("lp", lp).select(
        F.col("vec_id").cast("string").alias("request_id"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"),
        F.lit("injected").alias("lp_source"), top.alias("logprobs"))


LP = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: -abs(x::DOUBLE)) AS lp FROM embeddings),
       tok AS (SELECT vec_id, i, lp[i] AS l, list_transform(lp[i:i + 3], lambda x: exp(x)) AS top FROM e, unnest(range(1, len(lp) + 1)) u(i)),
       per AS (SELECT vec_id, exp(l) AS p, l, top, list_sum(top) AS mass, list_reverse_sort(top) AS srt FROM tok),
       sc AS (SELECT vec_id, count(*) AS scored_tokens, exp(-avg(greatest(l, ln(1e-12)))) AS perplexity,
         avg(-list_sum(list_transform(top, lambda x: x / mass * ln(x / mass)))) AS entropy, avg(p) AS confidence_mean, stddev_samp(p) AS confidence_std,
         min(p) AS confidence_min, avg(CASE WHEN len(srt) >= 2 THEN greatest(0, srt[1] - srt[2]) END) AS margin_mean,
         avg(CASE WHEN p < 0.5 THEN 1.0 ELSE 0 END) AS low_confidence_ratio FROM per GROUP BY vec_id)"""
CONF = ("perplexity", "entropy", "confidence_mean", "confidence_std", "confidence_min", "margin_mean", "low_confidence_ratio")


@query("c_score_confidence", f"WITH {LP} SELECT vec_id::VARCHAR AS request_id, scored_tokens, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in CONF) + " FROM sc")
def c_score_confidence(spark, sf):
    d = R.score_confidence(logprob_rows(spark, sf), F.col("logprobs"))
    return out(d.select("request_id", "scored_tokens", *CONF))


@query("c_conf_metadata", f"""WITH {LP} SELECT vec_id::VARCHAR AS request_id, 'injected' AS logprobs_source, scored_tokens, round(perplexity, 4) AS perplexity,
       round(entropy, 4) AS token_entropy_nats, round(confidence_mean, 4) AS confidence_mean, round(confidence_min, 4) AS confidence_min,
       round(confidence_std, 4) AS confidence_std, round(margin_mean, 4) AS token_margin_mean,
       round_even(low_confidence_ratio, 4) AS low_confidence_token_ratio FROM sc""")
def c_conf_metadata(spark, sf):
    return R.conf_metadata(R.score_confidence(logprob_rows(spark, sf), F.col("logprobs")))


@query("c_low_confidence_responses", f"""WITH {LP} SELECT 'm' || (label % 3)::VARCHAR AS model, count(*) AS scored,
       sum(CASE WHEN confidence_mean < 0.9 THEN 1 ELSE 0 END)::BIGINT AS low FROM sc JOIN embeddings USING (vec_id) GROUP BY 1""")
def c_low_confidence_responses(spark, sf):
    return R.low_confidence_responses(R.score_confidence(logprob_rows(spark, sf), F.col("logprobs"), 0.9), 0.9)

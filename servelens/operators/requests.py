"""Request and response records -> one fact row per completion."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as C
from ..functions import text as Q
from ..naming import DEFAULT_NAMING
from .slices import micros, running_total

# The path of completion calls and the call kinds.
COMPLETION_PATH = "/v1/chat/completions"
UNKNOWN = "unknown"

_TOOL = "STRUCT<id: STRING, type: STRING, index: INT, function: STRUCT<name: STRING, arguments: STRING>>"
_USAGE = ("STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT, "
          "prompt_tokens_details: STRUCT<cached_tokens: BIGINT>>")
BODY_SCHEMA = ("STRUCT<model: STRING, stream: STRING, temperature: DOUBLE, tools: STRING, "
               "messages: ARRAY<STRUCT<role: STRING, content: STRING>>, enable_thinking: STRING, "
               "logprobs: STRING, top_logprobs: INT>")
RESPONSE_SCHEMA = (f"STRUCT<id: STRING, model: STRING, choices: ARRAY<STRUCT<index: INT, finish_reason: STRING, "
                   f"message: STRUCT<role: STRING, content: STRING, tool_calls: ARRAY<{_TOOL}>>, "
                   f"logprobs: {C.LOGPROBS_SCHEMA}>>, usage: {_USAGE}>")
CHUNK_SCHEMA = (f"STRUCT<usage: {_USAGE}, choices: ARRAY<STRUCT<finish_reason: STRING, "
                f"delta: STRUCT<content: STRING, tool_calls: ARRAY<{_TOOL}>>>>>")


def truthy(c: Column) -> Column:
    """JSON truthiness of a value read as text."""
    falsy = ["", "false", "0", "0.0", "[]", "{}", "null"]
    return F.coalesce(~F.lower(F.regexp_replace(c, r"\s", "")).isin(falsy), F.lit(False))


def completions_only(df: DataFrame) -> DataFrame:
    """POST calls to the completion path; other calls never reach completion metrics."""
    return df.where((F.col("method") == "POST") & F.col("path").endswith(COMPLETION_PATH))


def traced_only(df: DataFrame, header: str = DEFAULT_NAMING.trace_header) -> DataFrame:
    """Drop calls that opted out of tracing with header value 0."""
    low = F.transform_keys("headers", lambda k, _: F.lower(k))
    return df.where(F.coalesce(low[header], F.lit("1")) != "0")


def call_kind(enable_thinking: Column) -> Column:
    return F.when(enable_thinking, "reasoning").otherwise("chat")


def status_class(status: Column) -> Column:
    """``4xx`` / ``5xx`` for errors, null otherwise; no status means the
    connection failed and counts as ``5xx``."""
    return F.when(status.isNull(), "5xx").when(
        status >= 400, F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))


def scoring_plan(wants_logprobs: Column, streaming: Column, request_id: Column, top: int,
                 sample: float) -> Column:
    """How log-probabilities are obtained: client, injected, destreamed or ''.

    Sampling is a deterministic hash of the request id, so a re-run picks the
    same requests.
    """
    top = max(0, min(10, top))
    sample = max(0.0, min(1.0, sample))
    chosen = F.pmod(F.xxhash64(request_id), F.lit(10000)) < int(sample * 10000)
    own = F.when(streaming, "").otherwise("client")
    if top <= 0:
        return F.when(wants_logprobs, own).otherwise("")
    return (F.when(wants_logprobs, own).when(~streaming, "injected")
            .when(chosen, "destreamed").otherwise(""))


def token_counts(usage: Column, messages: Column, content: Column) -> tuple[Column, Column]:
    """(prompt, completion) tokens: usage when present, else word counts."""
    words = F.aggregate(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")),
                        F.lit(0).cast("bigint"), lambda a, m: a + Q.word_count(m["content"]))
    prompt = F.when(usage.isNotNull(), F.coalesce(usage["prompt_tokens"], F.lit(0))).otherwise(words)
    done = F.when(usage.isNotNull(), F.coalesce(usage["completion_tokens"], F.lit(0))).otherwise(Q.word_count(content))
    return prompt.cast("bigint"), done.cast("bigint")


def cache_ratio(cached: Column, prompt: Column) -> Column:
    return F.when(prompt > 0, F.least(F.lit(1.0), cached / prompt.cast("double")))


def context_utilization(used: Column, max_context: Column) -> Column:
    return F.when(max_context > 0, F.least(F.lit(1.0), used / max_context.cast("double")))


def ttft(t_first: Column, t_send: Column, t_done: Column, source: Column) -> Column:
    """First token minus send; the whole time when nothing streamed; null for
    de-streamed calls, whose first token time means nothing."""
    return F.when(t_first.isNotNull(), t_first - t_send).when(source != "destreamed", t_done - t_send)


def token_rate(tokens: Column, gen: Column) -> Column:
    return F.when((tokens > 0) & (gen > 0), tokens / gen)


def parse_requests(df: DataFrame, default_model: str = "default", default_temperature: float = 0.0,
                   top: int = 0, sample: float = 0.0) -> DataFrame:
    """Typed columns out of request JSON, with the defaults of missing keys."""
    b = F.col("_b")
    streaming = truthy(b["stream"])
    d = df.withColumn("_b", F.from_json("body", BODY_SCHEMA))
    return (d.withColumns({
        "model": F.coalesce(b["model"], F.lit(default_model)), "streaming": streaming,
        "temperature": F.coalesce(b["temperature"], F.lit(float(default_temperature))),
        "tools_provided": truthy(b["tools"]), "messages": b["messages"],
        "kind": call_kind(truthy(b["enable_thinking"])),
        "lp_source": scoring_plan(truthy(b["logprobs"]), streaming, F.col("request_id"), top, sample)})
        .drop("_b"))


def tool_entries(calls: Column) -> Column:
    """(name, type) per call; the name falls back to the type, then ``unknown``."""
    def one(tc):
        typ = F.nullif(tc["type"], F.lit(""))
        return F.struct(F.coalesce(F.nullif(tc["function"]["name"], F.lit("")), typ, F.lit(UNKNOWN)).alias("name"),
                        F.coalesce(typ, F.lit(UNKNOWN)).alias("type"))

    return F.coalesce(F.transform(calls, one), F.array().cast("array<struct<name:string,type:string>>"))


def parse_responses(df: DataFrame) -> DataFrame:
    """Content, tools, usage, finish reason and logprobs of the first choice."""
    r = F.col("_r")
    first = F.try_element_at(r["choices"], F.lit(1))
    return (df.withColumn("_r", F.from_json("response", RESPONSE_SCHEMA)).withColumns({
        "content": F.coalesce(first["message"]["content"], F.lit("")),
        "tools": tool_entries(first["message"]["tool_calls"]),
        "usage": r["usage"], "finish_reason": first["finish_reason"],
        "logprobs": first["logprobs"]["content"]}).drop("_r"))


def request_facts(parsed: DataFrame, model_facts: DataFrame | None = None,
                  threshold: float = C.LOW_CONFIDENCE) -> DataFrame:
    """All derived columns of a completion, in one projection.

    ``parsed`` has request and response columns (see :func:`parse_requests`,
    :func:`parse_responses` or :func:`assemble_stream`).  ``model_facts``
    (``model, max_context``) is a dimension with one row per model.
    """
    prompt, done = token_counts(F.col("usage"), F.col("messages"), F.col("content"))
    d = completions_only(parsed).withColumns({
        "prompt_tokens": prompt, "completion_tokens": done,
        "cached_tokens": F.coalesce(F.col("usage")["prompt_tokens_details"]["cached_tokens"], F.lit(0)),
        "n_tool_calls": F.size("tools"),
        "queue_wait": F.col("t_send") - F.col("t_arrival"), "gen_seconds": F.col("t_done") - F.col("t_send"),
        "ttft_seconds": ttft(F.col("t_first"), F.col("t_send"), F.col("t_done"), F.col("lp_source")),
        "error_class": status_class(F.col("status")),
        "finish_reason": F.coalesce(F.nullif(F.col("finish_reason"), F.lit("")), F.lit(UNKNOWN))})
    d = d.withColumns({
        "cache_ratio": F.when(F.col("usage").isNotNull(), cache_ratio(F.col("cached_tokens"), F.col("prompt_tokens"))),
        "context_used": F.col("prompt_tokens") + F.col("completion_tokens"),
        "token_rate": token_rate(F.col("completion_tokens"), F.col("gen_seconds"))})
    if model_facts is not None:
        d = d.join(model_facts.select("model", "max_context"), "model", "left").withColumn(
            "context_utilization", context_utilization(F.col("context_used"), F.col("max_context")))
    d = score_text(d)
    if "logprobs" in d.columns:
        d = score_confidence(d, F.when(F.col("lp_source") != "", F.col("logprobs")), threshold)
    return d


def score_text(df: DataFrame) -> DataFrame:
    """Text heuristics and composite risk of ``content``."""
    d = df.withColumns({
        "repetition": Q.repetition(F.col("content")), "refusal": Q.refusal(F.col("content")),
        "hedging": Q.hedging(F.col("content")),
        "ungrounded": Q.ungrounded(F.col("content"), F.col("tools_provided"), F.col("n_tool_calls"))})
    d = d.withColumn("risk", Q.composite_risk(*[F.col(c) for c in ("repetition", "refusal", "hedging", "ungrounded")]))
    return d.withColumn("flagged", Q.flagged(F.col("risk")))


def score_confidence(df: DataFrame, logprobs: Column, threshold: float = C.LOW_CONFIDENCE) -> DataFrame:
    """Confidence columns; all null when nothing is scorable."""
    d = df.withColumns({"_lp": logprobs}).withColumn("_p", C.token_probs(F.col("_lp")))
    ok = F.coalesce(F.size("_p"), F.lit(0)) > 0
    p = F.col("_p")
    cols = {
        "scored_tokens": F.size(p).cast("bigint"), "perplexity": C.perplexity(p),
        "entropy": C.token_entropy(F.col("_lp")), "confidence_mean": C.confidence_mean(p),
        "confidence_std": C.confidence_std(p), "confidence_min": C.confidence_min(p),
        "margin_mean": C.top2_margin(F.col("_lp")), "low_confidence_ratio": C.low_confidence_ratio(p, threshold)}
    return d.withColumns({n: F.when(ok, c) for n, c in cols.items()}).drop("_lp", "_p")


def conf_metadata(scored: DataFrame) -> DataFrame:
    """Confidence values rounded to four digits (half to even) for trace metadata."""
    names = {"perplexity": "perplexity", "token_entropy_nats": "entropy", "confidence_mean": "confidence_mean",
             "confidence_min": "confidence_min", "confidence_std": "confidence_std",
             "token_margin_mean": "margin_mean", "low_confidence_token_ratio": "low_confidence_ratio"}
    return scored.where(F.col("scored_tokens").isNotNull()).select(
        "request_id", F.col("lp_source").alias("logprobs_source"), "scored_tokens",
        *[F.bround(F.col(src), 4).alias(name) for name, src in names.items()])


def feedback_scores(facts: DataFrame, with_confidence: bool = True) -> DataFrame:
    """In-band scores per request: ``(request_id, name, value, category)``; higher is better."""
    rows = [F.struct(F.lit("hallucination_quality").alias("name"), F.bround(1.0 - F.col("risk"), 3).alias("value"),
                     F.lit("quality").alias("category_name")),
            F.struct(F.lit("hallucination_flagged").alias("name"),
                     F.when(F.col("flagged"), 0.0).otherwise(1.0).alias("value"),
                     F.lit("safety").alias("category_name"))]
    if with_confidence:
        rows.append(F.struct(F.lit("token_confidence").alias("name"),
                             F.bround(F.col("confidence_mean"), 3).alias("value"),
                             F.lit("quality").alias("category_name")))
    return (facts.select("request_id", F.explode(F.array(*rows)).alias("s")).select("request_id", "s.*")
            .where(F.col("value").isNotNull()))


def low_confidence_responses(scored: DataFrame, threshold: float = C.LOW_CONFIDENCE) -> DataFrame:
    """Scored completions and those below the threshold, by model."""
    return scored.groupBy("model").agg(
        F.count("confidence_mean").alias("scored"),
        F.coalesce(F.sum(F.when(F.col("confidence_mean") < threshold, 1).otherwise(0)), F.lit(0)).alias("low"))


def scoring_coverage(facts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of requests scored, per group and source."""
    total = facts.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))
    per = facts.where(F.col("lp_source") != "").groupBy(*by, "lp_source").agg(F.count(F.lit(1)).alias("scored"))
    if by:
        j = per.join(total, list(by))
    else:
        j = per.withColumn("requests", total.select("requests").scalar())
    return j.select(*by, "lp_source", "scored", "requests",
                    (100.0 * F.col("scored") / F.greatest("requests", F.lit(1))).alias("coverage"))


def count_by_labels(df: DataFrame, labels: list[str], amount: str | None = None) -> DataFrame:
    """Counter value per label set: rows, or the sum of ``amount``."""
    v = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return df.groupBy(*labels).agg(v.alias("value"))


def latest_gauge(df: DataFrame, by: list[str], value: str, ts: str, tie: str | None = None) -> DataFrame:
    """Value of the most recent request per label set."""
    rank = F.struct(ts, tie) if tie else F.col(ts)
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, rank).alias("value"))


def explode_tool_calls(facts: DataFrame, keep: list[str]) -> DataFrame:
    return facts.select(*keep, F.explode("tools").alias("_t")).select(
        *keep, F.col("_t.name").alias("tool"), F.col("_t.type").alias("type"))


def _chunk_json(payload: Column) -> Column:
    """JSON text of a chunk line: without the ``data:`` prefix and outer blanks."""
    body = F.when(payload.startswith("data:"), F.expr("substring(payload, 6)")).otherwise(payload)
    return F.btrim(body, F.lit(" \t\r\n\x0b\x0c"))


def assemble_stream(chunks: DataFrame) -> DataFrame:
    """Streamed chunks -> one row per request.

    Name fragments are joined per tool call id and fragments without an id are
    ignored; usage is the last one sent; the finish reason is that of the last
    chunk with choices even when it is null; ``[DONE]`` and broken JSON are
    skipped.  One shuffle on ``request_id``; what a group collects is the
    completion itself.
    """
    text = _chunk_json(F.col("payload"))
    d = chunks.withColumn("_p", text).where((F.col("_p") != "") & (F.col("_p") != "[DONE]"))
    d = d.withColumn("_j", F.from_json("_p", CHUNK_SCHEMA)).withColumn(
        "_has_usage", F.coalesce(F.array_contains(F.json_object_keys("_p"), "usage"), F.lit(False)))
    first = F.try_element_at(F.col("_j.choices"), F.lit(1))
    some = F.size(F.coalesce(F.col("_j.choices"), F.array().cast(
        "array<struct<finish_reason:string,delta:struct<content:string,tool_calls:"
        "array<struct<id:string,type:string,index:int,function:struct<name:string,arguments:string>>>>>>"))) > 0
    d = d.select("request_id", "seq", "recv_ts", "_has_usage", F.col("_j.usage").alias("_u"), some.alias("_some"),
                 first["finish_reason"].alias("_fr"), first["delta"]["content"].alias("_c"),
                 F.filter(first["delta"]["tool_calls"], lambda t: F.coalesce(t["id"], F.lit("")) != "").alias("_t"))
    has_text = F.coalesce(F.col("_c"), F.lit("")) != ""
    g = d.groupBy("request_id").agg(
        F.collect_list(F.when(has_text, F.struct("seq", F.col("_c").alias("c")))).alias("_parts"),
        F.collect_list(F.when(F.size("_t") > 0, F.struct("seq", F.col("_t").alias("t")))).alias("_tools"),
        F.max_by("_u", F.when(F.col("_has_usage"), F.col("seq"))).alias("usage"),
        F.max_by("_fr", F.when(F.col("_some"), F.col("seq"))).alias("finish_reason"),
        F.min(F.when(has_text, F.col("recv_ts"))).alias("t_first"))
    frags = F.flatten(F.transform(F.sort_array("_tools"), lambda x: x["t"]))
    g = g.withColumn("_frags", frags)
    ids = F.array_distinct(F.transform("_frags", lambda t: t["id"]))

    def fold(i):
        mine = F.filter("_frags", lambda t: t["id"] == i)
        name = F.array_join(F.transform(mine, lambda t: F.coalesce(t["function"]["name"], F.lit(""))), "")
        types = F.filter(F.transform(mine, lambda t: t["type"]), lambda x: F.coalesce(x, F.lit("")) != "")
        typ = F.try_element_at(types, F.lit(-1))
        return F.struct(F.coalesce(F.nullif(name, F.lit("")), typ, F.lit(UNKNOWN)).alias("name"),
                        F.coalesce(typ, F.lit(UNKNOWN)).alias("type"))

    return g.select("request_id",
                    F.array_join(F.transform(F.sort_array("_parts"), lambda x: x["c"]), "").alias("content"),
                    F.transform(ids, fold).alias("tools"), "usage", "finish_reason", "t_first")


def stream_completion_tokens(assembled: DataFrame) -> DataFrame:
    """Completion tokens of a stream: usage if it is not zero, else words."""
    u = F.col("usage")["completion_tokens"]
    return assembled.withColumn("completion_tokens", F.when(F.coalesce(u, F.lit(0)) != 0, u)
                                .otherwise(Q.word_count(F.col("content"))))


def assemble_tool_args(chunks: DataFrame) -> DataFrame:
    """Alternative fold by call index: ``(request_id, index, name, arguments)``;
    calls that never got a name are dropped."""
    d = chunks.withColumn("_p", _chunk_json(F.col("payload"))).withColumn("_j", F.from_json("_p", CHUNK_SCHEMA))
    t = (d.select("request_id", "seq", F.posexplode("_j.choices").alias("_cp", "_ch"))
         .select("request_id", "seq", "_cp", F.posexplode("_ch.delta.tool_calls").alias("_tp", "_tc")))
    t = t.select("request_id", F.coalesce("_tc.index", F.lit(0)).alias("index"),
                 F.struct("seq", "_cp", "_tp", F.coalesce("_tc.function.name", F.lit("")).alias("n"),
                          F.coalesce("_tc.function.arguments", F.lit("")).alias("a")).alias("f"))
    g = t.groupBy("request_id", "index").agg(F.sort_array(F.collect_list("f")).alias("f"))
    return g.select("request_id", "index", F.array_join(F.transform("f", lambda x: x["n"]), "").alias("name"),
                    F.array_join(F.transform("f", lambda x: x["a"]), "").alias("arguments")).where("name <> ''")


def first_token_time(chunks: DataFrame) -> DataFrame:
    """Earliest chunk with non-empty content per request."""
    j = F.from_json(_chunk_json(F.col("payload")), CHUNK_SCHEMA)
    text = F.try_element_at(j["choices"], F.lit(1))["delta"]["content"]
    return chunks.groupBy("request_id").agg(
        F.min(F.when(F.coalesce(text, F.lit("")) != "", F.col("recv_ts"))).alias("t_first"))


def strip_logprobs(df: DataFrame, response: str = "response") -> DataFrame:
    """Choices of the response without their ``logprobs``; ``logprobs_removed`` flags a hit.

    ``choices`` becomes one map of field name to JSON text per choice.
    """
    raw = F.from_json(F.get_json_object(response, "$.choices"), "ARRAY<MAP<STRING, STRING>>")
    return (df.withColumn("_c", raw).withColumns({
        "logprobs_removed": F.coalesce(F.exists("_c", lambda m: m["logprobs"].isNotNull()), F.lit(False)),
        "choices": F.transform("_c", lambda m: F.map_filter(m, lambda k, _: k != "logprobs"))}).drop("_c"))


def zero_completion_share(facts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of completions with no tokens and no text, and of dead streams
    (first token time equal to the whole time)."""
    dead = (F.col("completion_tokens") == 0) & (F.coalesce(F.col("content"), F.lit("")) == "")
    same = F.col("ttft_seconds") == F.col("gen_seconds")
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.when(dead, 1.0).otherwise(0.0)).alias("zero_share"),
        F.avg(F.when(dead & same, 1.0).otherwise(0.0)).alias("dead_stream_share"))


def concurrency_timeline(df: DataFrame, start: str, end: str, by: list[str], tie: str,
                         slice_seconds: int = 3600) -> DataFrame:
    """In-flight requests after every start and end: ``(by.., ts, tie, delta, in_flight)``.

    Ends sort before starts at the same instant.
    """
    ev = df.select(*by, F.col(tie), F.explode(F.array(
        F.struct(F.col(start).alias("ts"), F.lit(1).alias("delta")),
        F.struct(F.col(end).alias("ts"), F.lit(-1).alias("delta")))).alias("e")).select(*by, tie, "e.*")
    return running_total(ev, by, ["ts", "delta", tie], {"in_flight": F.col("delta")},
                         micros("ts"), slice_seconds * 1_000_000)

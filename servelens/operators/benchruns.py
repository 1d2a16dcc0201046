"""Benchmark results, agent runs, engine comparison."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector as V
from .histograms import histogram_quantile
from .samples import Grid, counter_increments, gauge_rollup, instant, matcher, normalise_labels, rate
from .slices import carry_forward, join_on, micros
from .stats import nearest_rank, p95_minus_one


def result_columns(df: DataFrame) -> DataFrame:
    """Generation time, tokens per second and prompt tokens of a streamed run.

    Needs ``t_send, t_done, ttft, usage_completion, usage_prompt, content, prompt``.
    """
    from ..functions.text import word_count
    gen = F.greatest(F.lit(1e-9), F.col("t_done") - (F.col("t_send") + F.coalesce("ttft", F.lit(0.0))))
    comp = F.coalesce(F.nullif(F.col("usage_completion"), F.lit(0)), word_count(F.col("content")))
    prompt = F.coalesce(F.nullif(F.col("usage_prompt"), F.lit(0)),
                        F.greatest(F.lit(1), F.floor(F.length("prompt") / 3)))
    d = df.withColumns({"gen_time": gen, "comp_tokens": comp.cast("bigint"), "prompt_tokens": prompt.cast("bigint"),
                        "total": F.col("t_done") - F.col("t_send")})
    return d.withColumn("tps", F.col("comp_tokens") / F.col("gen_time"))


def bench_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Requests, errors, percentiles and throughput per label.

    ``wall`` is the longest request.  All percentiles come from one stacked
    rank selection.
    """
    ok = F.col("ok")
    base = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.when(ok, 0).otherwise(1)).alias("errors"),
        F.max("total").alias("wall"), F.coalesce(F.sum(F.when(ok, F.col("comp_tokens"))), F.lit(0)).alias("tokens"))
    stacked = results.where(ok).select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in ("ttft", "total", "tps")])).alias("s"))
    ranks = nearest_rank(stacked.select(*by, "s.*"), [*by, "measure"], "v", {"p50": 50, "p95": 95, "p99": 99})
    wanted = (("ttft", ("p50", "p95", "p99")), ("total", ("p50", "p95")), ("tps", ("p50", "p95")))
    wide = ranks.groupBy(*by).agg(*[F.max(F.when(F.col("measure") == m, F.col(p))).alias(f"{m}_{p}")
                                    for m, ps in wanted for p in ps])
    return join_on(base, wide, by, "left").select(
        *by, "requests", "errors", F.bround(F.col("errors") / F.col("requests"), 4).alias("error_rate"),
        *[f"{m}_{p}" for m, ps in wanted for p in ps],
        F.when(F.col("wall") != 0, F.bround(F.col("tokens") / F.col("wall"), 1)).alias("throughput_tok_s"),
        F.bround("wall", 1).alias("wall_s"))


def scenario_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of TTFT and total, mean rate and tokens."""
    return results.groupBy(*by).agg(
        *[f(c).alias(n) for c, f, n in (
            ("ttft", F.avg, "ttft_mean"), ("ttft", F.stddev_pop, "ttft_pstdev"), ("total", F.avg, "total_mean"),
            ("total", F.stddev_pop, "total_pstdev"), ("tps", F.avg, "tps_mean"), ("comp_tokens", F.avg, "comp_tokens_mean"),
            ("prompt_tokens", F.avg, "prompt_tokens_mean"))])


def burst_summary(results: DataFrame, wall: Column, by: list[str]) -> DataFrame:
    """Requests, wall time, mean latency, off-by-one p95 and tokens per second of a burst.

    ``wall`` is an aggregate expression (for example last end minus first start).
    """
    base = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), wall.alias("wall"), F.avg("total").alias("mean_latency"),
        F.sum("comp_tokens").alias("_tok"))
    return join_on(base, p95_minus_one(results, by, "total"), by, "left").withColumn(
        "throughput", F.try_divide(F.col("_tok"), F.col("wall"))).drop("_tok")


def sweep_compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Both values and their ratio ``b / a`` per concurrency level, and whether the
    level is the peak of either side.

    A sweep holds one row per level.
    """
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    top = j.agg(F.struct(F.max_by(key, "a").alias("pa"), F.max_by(key, "b").alias("pb")).alias("s")).scalar()
    return (j.withColumn("_s", top).withColumns({
        "ratio": F.try_divide(F.col("b"), F.col("a")), "peak_a": F.col(key) == F.col("_s.pa"),
        "peak_b": F.col(key) == F.col("_s.pb")}).drop("_s"))


def agent_runs(turns: DataFrame) -> DataFrame:
    """Per run: turns, calls, calls whose arguments are valid JSON, done flag, TTFT and wall.

    A run is done when one of its turns made no tool call.
    """
    calls = F.coalesce(F.size("tool_calls"), F.lit(0))
    valid = F.coalesce(F.size(F.filter("tool_calls", lambda c: F.try_parse_json(c["arguments"]).isNotNull())), F.lit(0))
    return turns.groupBy("run_id", "scenario").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(calls).alias("calls"),
        F.sum(valid).alias("valid_calls"),
        F.max(calls == 0).alias("done"), F.avg("ttft").alias("ttft_mean"), F.max("ttft").alias("ttft_max"),
        F.avg("wall").alias("turn_wall_mean"), F.sum("wall").alias("wall"))


def agent_summary(runs: DataFrame, by: list[str] = ("scenario",)) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed"), F.sum(F.col("done").cast("int")).alias("done_in_budget"),
        F.avg("turns").alias("turns_mean"), F.avg("calls").alias("calls_mean"),
        F.coalesce(F.try_divide(F.sum("valid_calls"), F.sum("calls")), F.lit(0.0)).alias("valid_rate"),
        F.avg(F.when(F.col("ttft_mean") != 0, F.col("ttft_mean"))).alias("ttft_mean"),
        F.max("ttft_max").alias("ttft_max"), F.avg("wall").alias("wall_mean"))


def asof_snapshot(results: DataFrame, snapshots: DataFrame, keys: list[str], values: list[str], ts: str = "ts",
                  slice_seconds: int = 86400) -> DataFrame:
    """Attach the latest snapshot at or before each result (as-of join).

    Union, slice by time and carry the last snapshot forward, inside and between
    slices; no range join.  A snapshot at the same instant counts.
    """
    cols = [c for c in results.columns if c not in (*keys, ts)]
    # snapshots first at equal times
    s = snapshots.select(*keys, F.col(ts).alias("_ts"), F.lit(0).alias("_side"),
                         F.struct(F.col(ts).alias("snapshot_ts"), *values).alias("_snap"))
    r = results.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"),
                       F.struct(*[F.col(c) for c in cols]).alias("_row"))
    u = s.unionByName(r, allowMissingColumns=True)
    order = ["_ts", "_side"]
    filled = carry_forward(u, keys, order, {"_at": "_snap"}, micros("_ts"), slice_seconds * 1_000_000,
                           F.struct("_ts", "_side"))
    return filled.where("_side = 1").select(
        *keys, F.col("_ts").alias(ts), *[F.col("_row")[c].alias(c) for c in cols], F.col("_at.snapshot_ts"),
        *[F.col("_at")[v].alias(v) for v in values])


def snapshot_stats(results: DataFrame, snapshots: DataFrame, keys: list[str], by: list[str],
                   values: list[str]) -> DataFrame:
    """Mean cluster state seen by the requests of each run."""
    j = asof_snapshot(results, snapshots, keys, values)
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count("snapshot_ts").alias("with_snapshot"),
                              *[F.avg(v).alias(f"{v}_mean") for v in values])


def crash_request_join(crashes: DataFrame, requests: DataFrame, gap: float, bucket: int,
                       by: list[str] = (), salt: int = 8) -> DataFrame:
    """Requests in flight when a crash happened: crash in ``[start, end + gap]``.

    Requests are unfolded into the time buckets they cover, crashes fall in one
    bucket; equi-join on the bucket, then the exact test.  ``bucket`` should be
    about one request length, so a request covers few buckets.  A busy bucket is
    spread over ``salt`` keys; the few crashes are repeated for each.
    """
    us = bucket * 1_000_000
    r = requests.withColumns({
        "_b": F.explode(F.sequence(F.floor(micros("start_ts") / us), F.floor((micros("end_ts") + int(gap * 1e6)) / us)))})
    r = r.withColumn("_s", F.pmod(F.xxhash64("start_ts", "end_ts"), F.lit(salt)).cast("int"))
    c = crashes.withColumn("_b", F.floor(micros("crash_ts") / us)).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    hit = (F.col("crash_ts") >= F.col("start_ts")) & (micros("crash_ts") <= micros("end_ts") + int(gap * 1e6))
    return c.join(r, [*by, "_b", "_s"]).where(hit).drop("_b", "_s")


# Metric names per engine for the shared namespace.
ENGINE_METRICS = {
    "tokens_generated_rate1m": (("tokens_completion_total", True), ("vllm:generation_tokens_total", False),
                                ("sglang:num_generated_tokens_total", False)),
    "ttft_p95": (("ttft_seconds_bucket", True), ("vllm:time_to_first_token_seconds_bucket", False),
                 ("sglang:time_to_first_token_seconds_bucket", False)),
    "requests_running": (("in_flight", True), ("vllm:num_requests_running", False), ("sglang:num_running_reqs", False)),
    "kv_cache_usage_ratio": (("kv_cache_utilization", True), ("vllm:gpu_cache_usage_perc", False),
                             ("sglang:token_usage", False)),
    "errors_rate5m": (("error_total", True), ("vllm:request_success_total", False)),
}


def _engine_series(samples: DataFrame, names: list[str], labels: list[str], where=None) -> DataFrame:
    """Samples of several metrics at once; ``rank`` is the position of the metric in ``names``."""
    lab = F.col("labels")
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric")).cast("int")
    d = samples.where(F.col("metric").isin(names))
    if where is not None:
        d = d.where(where)
    return d.select(normalise_labels(lab).alias("series"), rank.alias("rank"),
                    *[F.coalesce(lab[n], F.lit("")).alias(n) for n in labels], "ts", "value")


def _preferred(v: DataFrame, record: str) -> DataFrame:
    """``a or b or c``: at each time and provider the value of the first metric that has one."""
    ok = v.where(F.col("value").isNotNull())
    return ok.groupBy("t", "provider").agg(F.min_by("value", "rank").alias("value")).select(
        F.lit(record).alias("record"), "t", "provider", "value")


def normalize_engines(samples: DataFrame, grid: Grid, prefix: str, up_jobs: str = ".*",
                      records: list[str] | None = None) -> DataFrame:
    """Engine-specific metrics -> one namespace ``(record, t, provider, value)``.

    Each record reads all engines' metrics in one pass; where several exist for
    the same time and provider the earlier name wins.
    """
    res = grid.step
    own = {r: [(prefix + n) if ours else n for n, ours in names] for r, names in ENGINE_METRICS.items()}
    key = ["rank", "provider"]

    def counters(record, window, by, where=None):
        d = _engine_series(samples, own[record], [c for c in by if c != "rank"], where)
        return rate(counter_increments(d, res), window, grid, by)

    def gauges(record, fn):
        d = _engine_series(samples, own[record], ["provider"])
        return V.agg_by(instant(gauge_rollup(d, res), grid), fn, key)

    def up():
        d = _engine_series(samples, ["up"], ["provider"], matcher(F.col("labels"), re={"job": up_jobs}))
        return V.agg_by(instant(gauge_rollup(d, res), grid), "max", key)

    aborted = ~F.col("metric").contains(":") | (F.col("labels")["finished_reason"] == "abort")
    build = {
        "up": up,
        "tokens_generated_rate1m": lambda: counters("tokens_generated_rate1m", 60, key),
        "ttft_p95": lambda: histogram_quantile(0.95, counters("ttft_p95", 300, [*key, "le"])),
        "requests_running": lambda: gauges("requests_running", "sum"),
        "kv_cache_usage_ratio": lambda: gauges("kv_cache_usage_ratio", "max"),
        "errors_rate5m": lambda: counters("errors_rate5m", 300, key, aborted)}
    parts = [_preferred(build[r](), r) for r in (records or build)]
    return reduce(DataFrame.unionByName, parts)

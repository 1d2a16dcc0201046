"""A full samples table derived from ``events``: every metric the rules and panels read.

Time runs sixty times faster (30 days become 12 hours), so that five-minute
windows hold data.  Counters restart once per original day.
"""

from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servelens.naming import BOUNDS, DEFAULT_NAMING
from servelens.operators import samples as S
from servelens.operators.samples import Grid
from servelens.plans.source import Source

from .adapters import EV, T0, bucket_counts, events

FAST = 60
# Gauges that come out of one pass over the calls: code for many more is too long for the JVM to compile.
TOGETHER = 8
GRID = Grid(T0, T0 + 43200, 60)

FAST_EV = EV.replace("ev AS (", "ev0 AS (") + f""", ev AS (
  SELECT * REPLACE ({T0}000000 + (us - {T0}000000) // {FAST} AS us) FROM ev0)"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    us = F.lit(T0 * 1_000_000) + F.floor((F.col("us") - F.lit(T0 * 1_000_000)) / FAST)
    return events(spark, sf).withColumn("us", us.cast("bigint")).withColumn("ts", F.timestamp_micros("us"))


def _map(labels: dict[str, str | Column]) -> Column:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _sample(d: DataFrame, metric: str, labels: dict[str, str | Column], value: Column, own: bool = True):
    name = DEFAULT_NAMING.m(metric) if own else metric
    return name, d.select(F.lit(name).alias("metric"), _map(labels).alias("labels"), "ts", value.cast("double").alias("value"))


def _counter(d: DataFrame, metric: str, labels: list[str], amount: Column, job: str = "proxy", where: Column | None = None):
    d = d if where is None else d.where(where)
    w = Window.partitionBy(*labels, "day").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(*labels, "ts", F.sum(amount).over(w).alias("_v"))
    return _sample(d, metric, {**{c: F.col(c) for c in labels}, "job": DEFAULT_NAMING.j(job)}, F.col("_v"))


def _histogram(d: DataFrame, metric: str, col: str):
    b = bucket_counts(d, col, BOUNDS[metric], ["model"])
    labels = {"model": F.col("model"), "le": F.col("le"), "job": DEFAULT_NAMING.j("proxy")}
    return [_sample(b, metric + "_bucket", labels, F.col("value")), _counter(d, metric + "_count", ["model"], F.lit(1))]


def samples_by_metric(spark: SparkSession, sf: str) -> dict[str, list[DataFrame]]:
    """One sample per event and metric, kept apart by metric name."""
    return _derived(spark, sf)[0]


def _derived(spark: SparkSession, sf: str) -> tuple[dict[str, list[DataFrame]], DataFrame, dict[str, list[Column]]]:
    """Samples by metric; the calls; and of the metrics that are gauges, per call, structs (metric, labels, value) or null.

    Means that a rule compares are of binary fractions, so that Spark's exact sums and DuckDB's agree at the limit.
    """
    d = calls(spark, sf)
    k, v = F.col("k"), F.col("value")
    e = d.withColumns({
        "status_class": F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")),
        "tool": F.concat(F.lit("t"), (k % 5).cast("string")), "type": F.lit("function"),
        "reason": F.when(k % 3 == 0, "length").otherwise("stop"),
        "source": F.when(k % 2 == 0, "injected").otherwise("client"),
        "severity": F.when(k % 3 == 0, "error").otherwise("info"), "category": F.col("event_type"),
        "result": F.when(k % 2 == 0, "ok").otherwise("fail"), "iface": F.lit("en0")})
    err = F.col("status") >= 400
    parts = [
        _counter(e, "requests_total", ["model", "streaming", "kind", "node"], F.lit(200)),
        _counter(e, "tokens_prompt_total", ["model", "kind"], k * 3),
        _counter(e, "tokens_completion_total", ["model", "kind"], k),
        _counter(e, "tool_calls_total", ["model", "kind", "tool", "type"], F.lit(1), where=k % 2 == 0),
        _counter(e, "finish_reason_total", ["model", "reason", "kind"], F.lit(1)),
        _counter(e, "hallucination_flag_total", ["model"], F.lit(1), where=k > 80),
        _counter(e.where(err).withColumn("status", F.col("status_class")), "error_total", ["model", "status", "kind"], k),
        _counter(e, "prompt_cached_tokens_total", ["model", "kind"], k),
        _counter(e, "confidence_scored_total", ["model", "source"], F.lit(1), where=F.col("model") != "m2"),
        _counter(e, "low_confidence_response_total", ["model"], F.lit(1), where=k < 10),
        *_histogram(d, "ttft_seconds", "ttft"), *_histogram(d, "generation_seconds", "gen"),
        *_histogram(d.withColumn("rate", k / F.greatest(F.col("gen"), F.lit(0.1))), "token_rate_tokens_per_second", "rate"),
        *_histogram(d.withColumn("wait", F.col("ttft") / 10), "queue_wait_seconds", "wait"),
        _counter(e, "log_tailer_lines_total", ["severity", "category"], F.lit(1), "logtailer"),
        _counter(e, "log_tailer_shipped_total", ["severity"], F.lit(1), "logtailer", k < 30),
        _counter(e, "log_tailer_dropped_total", ["reason"], F.lit(1), "logtailer"),
        _counter(e, "log_tailer_errors_total", [], F.lit(1), "logtailer", k == 7),
        _counter(e, "server_restarts_total", [], F.lit(1), "supervisor", (F.col("event_type") == "error") & (k > 90)),
        _counter(e, "server_health_checks_total", ["result"], F.lit(1), "supervisor"),
        _counter(e, "net_rx_bytes_total", ["node", "iface"], k * 1000, "hw"),
        _counter(e, "net_tx_bytes_total", ["node", "iface"], k * 900, "hw"),
        _counter(e, "net_rx_errors_total", ["node", "iface"], F.lit(1), "hw", k == 3),
        _counter(e, "net_tx_errors_total", ["node", "iface"], F.lit(1), "hw", k == 4),
    ]
    proxy, hw, sup = ({"job": DEFAULT_NAMING.j(j)} for j in ("proxy", "hw", "supervisor"))
    node, model, kind = {"node": F.col("node")}, {"model": F.col("model")}, {"kind": F.col("kind")}

    gauges: dict[str, list[Column]] = {}

    def gauge(metric, labels, value, where=None, own=True):
        name, part = _sample(d if where is None else d.where(where), metric, labels, value, own)
        parts.append((name, part))
        one = F.struct(F.lit(name).alias("metric"), _map(labels).alias("labels"), value.cast("double").alias("value"))
        gauges.setdefault(name, []).append(one if where is None else F.when(where, one))

    for name, value in {
            "hw_gpu_utilization_percent": F.least(v / 4, F.lit(100.0)), "hw_gpu_iokit_util_percent": k, "hw_gpu_frequency_mhz": k * 12,
            "hw_gpu_mem_used_bytes": k * 1e8, "hw_gpu_mem_alloc_bytes": F.least(v / 490, F.lit(1.0)) * 16e9,
            "hw_gpu_mem_total_bytes": F.lit(16e9), "hw_gpu_power_milliwatts": k * 100, "hw_cpu_power_milliwatts": k * 80,
            "hw_ane_power_milliwatts": k * 5, "hw_package_power_milliwatts": v * 100,
            "hw_thermal_pressure": F.when(k > 60, k / 100.0).otherwise(0.0), "hw_mem_pressure": v * 100,
            "hw_mem_used_bytes": k * 1e8, "hw_mem_total_bytes": F.lit(16e9), "hw_disk_used_bytes": v * 1e9,
            "hw_disk_total_bytes": F.lit(500e9), "hw_load1": v / 20, "hw_load5": v / 25, "hw_load15": v / 30, "hw_cpu_count": F.lit(8),
            "hw_uptime_seconds": F.col("us") / 1e6 - T0, "hw_up": F.lit(1), "worker_cpu_percent": k, "worker_rss_bytes": k * 1e7}.items():
        gauge(name, {**node, **hw}, value)
    for name, value in {
            "heuristic_repetition": F.least(v / 97, F.lit(1.0)), "heuristic_refusal": F.when(k < 30, 1.0).otherwise(0.0), "heuristic_hedging": k / 200,
            "heuristic_ungrounded": k / 300, "context_used_tokens": k * 4, "context_utilization": k / 100,
            "context_length_max_tokens": F.lit(32768), "kv_bytes_per_token": F.lit(114688), "prompt_cache_ratio": k / 100,
            "output_perplexity": 1 + v / 40, "token_entropy_nats": v / 300, "token_confidence_mean": 1 - k / 128,
            "token_margin_mean": F.col("cents") / 131072, "in_flight": k % 12}.items():
        gauge(name, {**model, **proxy}, value)
    gauge("temperature", {**model, **kind, **proxy}, k / 100)
    gauge("hallucination_risk", {**model, **kind, **proxy}, k / 100)
    gauge("up", {**proxy}, F.when(k > 3, 1).otherwise(0))
    for job in ("proxy", "hw", "kv", "supervisor", "logtailer"):
        gauge("up", {"job": DEFAULT_NAMING.j(job), **node, "instance": F.col("node")}, F.when(k > 5, 1).otherwise(0), own=False)
    for job in ("victoria-metrics", "vmalert", "alertmanager"):
        gauge("up", {"job": job, "instance": F.col("node"), "node": F.col("node")}, F.when(k > len(job), 1).otherwise(0), own=False)
    for name, value in {"server_up": k > 4, "server_ready": k > 20, "server_state": k % 4, "server_uptime_seconds": k * 60}.items():
        gauge(name, {**sup}, value.cast("double"))
    gauge("model_loaded", {**sup, **model}, (k > 30).cast("double"))
    gauge("server_last_crash_reason", {**sup, "reason": F.when(k % 2 == 0, "metal_gpu_error").otherwise("oom")}, (k > 50).cast("double"))
    for name in ("log_tailer_up", "log_tailer_queue_depth", "log_tailer_file_bytes"):
        gauge(name, {"job": DEFAULT_NAMING.j("logtailer")}, (k > 2).cast("double") if name.endswith("up") else k)
    for name, value in {"kv_cache_utilization": k / 100, "kv_est_bytes_max_context": k * 1e6, "kv_cache_max_sequences": F.lit(10)}.items():
        gauge(name, {"job": DEFAULT_NAMING.j("kv")}, value)
    for name in ("kv_cache_bytes", "kv_cache_sequences"):
        gauge(name, {"job": DEFAULT_NAMING.j("kv"), "type": F.element_at(F.array(*[F.lit(x) for x in ("total", "user", "assistant", "system")]),
                                                                          (k % 4 + 1).cast("int"))}, k * 1e6 if "bytes" in name else k)
    for i, attr in enumerate(("layer_count", "kv_heads", "head_dim", "hidden_size", "attention_heads", "vocab_size",
                              "intermediate_size", "quant_bits", "quant_group_size", "linear_key_heads", "linear_value_heads",
                              "linear_key_head_dim", "linear_value_head_dim", "linear_conv_kernel_dim", "mtp_layers")):
        gauge("model_info", {**model, "attr": attr, **proxy}, F.lit(8 * (i + 1)), where=F.col("event_id") % 15 == i)
    gauge("model_arch", {**model, "arch": "dense", "dtype": "bfloat16", **proxy}, F.lit(1))
    out: dict[str, list[DataFrame]] = {}
    for name, part in parts:
        out.setdefault(name, []).append(part)
    return out, d, gauges


def serving_samples(spark: SparkSession, sf: str) -> DataFrame:
    """All derived samples as one table."""
    return reduce(DataFrame.unionByName, [p for ps in samples_by_metric(spark, sf).values() for p in ps])


@dataclass(frozen=True)
class ByMetric(Source):
    """A source over samples kept apart by metric (a metric-partitioned table in memory).

    ``gauges`` holds the metrics that are one struct (metric, labels, value) or null per row of ``calls``:
    several of them come out of one pass over the calls.
    """

    parts: dict = field(default_factory=dict, hash=False)
    calls: DataFrame | None = field(default=None, hash=False)
    gauges: dict = field(default_factory=dict, hash=False)

    def _series(self, metric, labels, eq, re, raw):
        name = metric if raw else self.naming.m(metric)
        mine = reduce(DataFrame.unionByName, self.parts[name])
        return S.select_series(mine, name, list(labels), eq, re)

    def samples_of(self, metrics):
        parts = [p for m in metrics if m not in self.gauges for p in self.parts[m]]
        side = [g for m in metrics for g in self.gauges.get(m, ())]
        for i in range(0, len(side), TOGETHER):
            each = self.calls.select("ts", F.array(*side[i:i + TOGETHER]).alias("_s")).select("ts", F.explode("_s").alias("_s")).where("_s IS NOT NULL")
            parts.append(each.select("_s.metric", "_s.labels", "ts", "_s.value"))
        return reduce(DataFrame.unionByName, parts)


@lru_cache(maxsize=4)
def _shared(spark: SparkSession, sf: str, grid: Grid) -> Source:
    parts, d, gauges = _derived(spark, sf)
    return ByMetric(next(iter(parts.values()))[0], grid, parts=parts, calls=d, gauges=gauges)


def source(spark: SparkSession, sf: str, grid: Grid = GRID) -> Source:
    return _shared(spark, sf, grid)

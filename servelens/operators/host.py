"""Captured host-tool text and model configs -> gauges and facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_size
from .slices import micros, previous_row

NAN = float("nan")

# Gauge name, tool that prints it, pattern, factor, which match wins.
HOST_PATTERNS = (
    ("pages_free", "vm_stat", r"Pages free:\s+(\d+)", 1.0, "last"),
    ("pages_inactive", "vm_stat", r"Pages inactive:\s+(\d+)", 1.0, "last"),
    ("pages_speculative", "vm_stat", r"Pages speculative:\s+(\d+)", 1.0, "last"),
    ("cpu_temp_celsius", "powermetrics", r"(?i)(?:CPU die temperature|package.*temperature)\s*:\s*([\d.]+)", 1.0, "first"),
    ("gpu_utilization_percent", "powermetrics", r"GPU HW active residency:\s*([\d.]+)%", 1.0, "last"),
    ("gpu_frequency_mhz", "powermetrics", r"GPU HW active frequency:\s*([\d.]+)\s*MHz", 1.0, "last"),
    ("package_power_milliwatts", "powermetrics", r"(?i)Combined Power \(CPU \+ GPU \+ ANE\):\s*([\d.]+)\s*mW", 1.0, "last"),
    ("gpu_power_milliwatts", "powermetrics", r"(?i)GPU Power:\s*([\d.]+)\s*mW", 1.0, "last"),
    ("cpu_power_milliwatts", "powermetrics", r"(?i)CPU Power:\s*([\d.]+)\s*mW", 1.0, "last"),
    ("ane_power_milliwatts", "powermetrics", r"(?i)ANE Power:\s*([\d.]+)\s*mW", 1.0, "last"),
    ("gpu_mem_used_bytes", "ioreg", r'"In use system memory"=(\d+)', 1.0, "first"),
    ("gpu_mem_alloc_bytes", "ioreg", r'"Alloc system memory"=(\d+)', 1.0, "first"),
    ("gpu_mem_total_bytes", "ioreg", r'"VRAM,totalMB"=(\d+)', 1048576.0, "first"),
    ("gpu_iokit_util_percent", "ioreg", r'"Device Utilization %"=(\d+)', 1.0, "first"),
)
ATTRIBUTES = (
    ("layer_count", "layers"), ("kv_heads", "kv_heads"), ("head_dim", "head_dim"), ("hidden_size", "hidden_size"),
    ("attention_heads", "attention_heads"), ("vocab_size", "vocab_size"), ("intermediate_size", "intermediate_size"),
    ("quant_bits", "quant_bits"), ("quant_group_size", "quant_group_size"), ("linear_key_heads", "linear_key_heads"),
    ("linear_value_heads", "linear_value_heads"), ("linear_key_head_dim", "linear_key_head_dim"),
    ("linear_value_head_dim", "linear_value_head_dim"), ("linear_conv_kernel_dim", "linear_conv_kernel_dim"),
    ("mtp_layers", "mtp_layers"), ("tie_word_embeddings", "tie_word_embeddings"),
)
CONFIG_FIELDS = (
    ("max_context", "max_position_embeddings"), ("layers", "num_hidden_layers"), ("kv_heads", "num_key_value_heads"),
    ("head_dim", "head_dim"), ("hidden_size", "hidden_size"), ("attention_heads", "num_attention_heads"),
    ("vocab_size", "vocab_size"), ("intermediate_size", "intermediate_size"),
    ("linear_key_heads", "linear_num_key_heads"), ("linear_value_heads", "linear_num_value_heads"),
    ("linear_key_head_dim", "linear_key_head_dim"), ("linear_value_head_dim", "linear_value_head_dim"),
    ("linear_conv_kernel_dim", "linear_conv_kernel_dim"), ("mtp_layers", "mtp_num_hidden_layers"),
)
DEFAULT_CONTEXT = 32768
BYTES_PER_VALUE = 2
CACHE_SEQUENCES = 10


def _number(text: Column, pattern: str, which: str) -> Column:
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    one = F.try_element_at(got, F.lit(1 if which == "first" else -1))
    return F.nullif(one, F.lit("")).try_cast("double")


def parse_host_text(df: DataFrame) -> DataFrame:
    """``(node, ts, tool, text)`` -> ``(node, ts, gauge, value)``; a missing reading is NaN.

    One scan: each row unfolds only into the gauges of its own tool.
    """
    rows = F.array(*[F.struct(
        F.lit(tool).alias("tool"), F.lit(name).alias("gauge"),
        F.when(F.col("tool") == tool, _number(F.col("text"), pattern, which) * factor).alias("value"))
        for name, tool, pattern, factor, which in HOST_PATTERNS])
    d = df.select("node", "ts", F.explode(F.filter(rows, lambda r: r["tool"] == F.col("tool"))).alias("r"))
    return d.select("node", "ts", F.col("r.gauge").alias("gauge"), F.coalesce("r.value", F.lit(NAN)).alias("value"))


def memory_used(total: Column, free: Column, inactive: Column, speculative: Column, page_size: Column) -> Column:
    """Total minus reclaimable pages; a page count that was not printed is 0."""
    pages = sum((F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in (inactive, speculative)),
                F.coalesce(F.nanvl(free, F.lit(0.0)), F.lit(0.0)))
    return total - pages * page_size


def thermal_pressure(text: Column) -> Column:
    """0..1 from the scheduler limit; no such line means no pressure."""
    limit = _number(text, r"CPU_Scheduler_Limit:\s*(\d+)", "first")
    # greatest/least skip nulls, so the missing line is decided first
    return F.when(limit.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (100.0 - limit) / 100.0)))


def component_match(procs: DataFrame, needles: dict[str, str], command: str = "command") -> DataFrame:
    """One row per process and matching component (a process may match several).

    The needle list is part of the query, so the theta join is a filter over an
    array literal: no join, no shuffle.
    """
    table = F.array(*[F.struct(F.lit(n).alias("component"), F.lit(v).alias("needle")) for n, v in needles.items()])
    hit = F.filter(table, lambda x: F.col(command).contains(x["needle"]))
    return procs.withColumn("_m", F.explode(hit)).withColumn("component", F.col("_m.component")).drop("_m")


def process_rollup(procs: DataFrame, needles: dict[str, str], exclude: list[str] = (),
                   by: list[str] = ("node",)) -> DataFrame:
    """CPU % and resident bytes per component, zero when nothing matches."""
    d = procs
    for x in exclude:
        d = d.where(~F.col("command").contains(x))
    facts = component_match(d, needles).groupBy(*by, "component").agg(
        F.sum("cpu").alias("cpu"), F.sum(F.col("rss_kb") * 1024).alias("rss_bytes"))
    dim = procs.select(*by).distinct().withColumn(
        "component", F.explode(F.array(*[F.lit(n) for n in needles])))
    return dim.join(facts, [*by, "component"], "left").select(
        *by, "component", F.coalesce("cpu", F.lit(0.0)).alias("cpu"),
        F.coalesce("rss_bytes", F.lit(0)).cast("bigint").alias("rss_bytes"))


def worker_rollup(procs: DataFrame, match: str, exclude: list[str], by: list[str] = ("node",)) -> DataFrame:
    """CPU % and resident bytes of the processes that contain ``match``."""
    d = procs.where(F.col("command").contains(match))
    for x in exclude:
        d = d.where(~F.col("command").contains(x))
    return d.groupBy(*by).agg(F.sum("cpu").alias("cpu"),
                              F.sum(F.col("rss_kb") * 1024).cast("bigint").alias("rss_bytes"))


def container_match(containers: DataFrame, components: DataFrame) -> DataFrame:
    """Containers joined to their component by exact name; sizes and percents parsed."""
    return containers.join(components, "name").select(
        "component", F.rtrim(F.col("cpu_pct"), F.lit("%")).try_cast("double").alias("cpu"),
        parse_size(F.col("mem_usage")).alias("rss_bytes"))


def link_counters(df: DataFrame) -> DataFrame:
    """Counters of the ``<Link`` row of an interface table.

    ``(node, ts, iface, text)`` -> ``(node, ts, iface, rx_bytes, tx_bytes, rx_errors, tx_errors)``.
    """
    rows = F.transform(F.split("text", "\n"), lambda s: F.filter(F.split(F.trim(s), r"\s+"), lambda x: x != ""))
    hit = F.filter(rows, lambda f: (F.size(f) >= 10) & (F.try_element_at(f, F.lit(1)) == F.col("iface"))
                   & F.try_element_at(f, F.lit(3)).startswith("<Link"))
    d = df.withColumn("_f", F.try_element_at(hit, F.lit(1))).where("_f is not null")
    pos = {"rx_bytes": 7, "tx_bytes": 10, "rx_errors": 6, "tx_errors": 9}
    d = d.select("node", "ts", "iface", *[F.try_element_at("_f", F.lit(i)).try_cast("bigint").alias(n)
                                          for n, i in pos.items()])
    return d.where(" and ".join(f"{n} is not null" for n in pos))


def counter_delta(df: DataFrame, keys: list[str], fields: list[str], tie: str | None = None,
                  slice_seconds: int = 3600) -> DataFrame:
    """Per-field growth since the previous sample: 0 for the first sample and 0
    when the counter went down (unlike the reset rule of ``counter_increments``)."""
    order = ["ts"] + ([tie] if tie else [])
    d = previous_row(df, keys, order, {f"_p_{f}": f for f in fields}, micros("ts"),
                     slice_seconds * 1_000_000, F.struct(*order))
    return d.withColumns({f"{f}_delta": F.coalesce(F.greatest(F.col(f) - F.col(f"_p_{f}"), F.lit(0)), F.lit(0))
                          for f in fields}).drop(*[f"_p_{f}" for f in fields])


def model_facts(df: DataFrame, config: str = "config") -> DataFrame:
    """Typed facts out of a model's JSON config; 0 and missing are the same.

    Text dimensions may be nested under ``text_config``; quantisation may sit
    under either of two keys.
    """
    nested = F.get_json_object(config, "$.text_config")
    use = F.coalesce(F.regexp_replace(nested, r"\s", ""), F.lit("")).isin("", "{}", "null")
    text = F.when(use, F.col(config)).otherwise(nested)
    quant1 = F.get_json_object(config, "$.quantization")
    empty1 = F.coalesce(F.regexp_replace(quant1, r"\s", ""), F.lit("")).isin("", "{}", "null")
    quant = F.when(empty1, F.get_json_object(config, "$.quantization_config")).otherwise(quant1)

    def number(c):
        return F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("bigint")

    d = df.withColumns({"_t": text, "_q": quant})
    cols = {name: number(F.get_json_object("_t", f"$.{key}")) for name, key in CONFIG_FIELDS}
    cols["quant_bits"] = number(F.get_json_object("_q", "$.bits"))
    cols["quant_group_size"] = number(F.get_json_object("_q", "$.group_size"))
    cols["arch"] = F.coalesce(F.get_json_object(config, "$.architectures[0]"), F.lit(""))
    cols["dtype"] = F.coalesce(F.get_json_object("_t", "$.dtype"), F.lit(""))
    tied = F.lower(F.coalesce(F.get_json_object("_t", "$.tie_word_embeddings"), F.lit("false")))
    cols["tie_word_embeddings"] = F.when(tied.isin("true", "1"), 1).otherwise(0).cast("bigint")
    d = d.withColumns(cols).drop("_t", "_q")
    return d.withColumn("max_context", F.when(F.col("max_context") == 0, DEFAULT_CONTEXT).otherwise(F.col("max_context")))


def kv_bytes(facts: DataFrame, sequences: int = CACHE_SEQUENCES) -> DataFrame:
    """Cache bytes per token, per full-length sequence and for the whole cache."""
    per = F.col("layers") * 2 * F.col("kv_heads") * F.col("head_dim") * BYTES_PER_VALUE
    return facts.withColumn("kv_bytes_per_token", per).withColumns({
        "kv_bytes_full_context": F.col("kv_bytes_per_token") * F.col("max_context"),
        "kv_capacity_bytes": F.col("kv_bytes_per_token") * F.col("max_context") * sequences})


def model_info_long(facts: DataFrame) -> DataFrame:
    """``(model, attr, value)`` for the sixteen attributes."""
    rows = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(c).cast("double").alias("value")) for a, c in ATTRIBUTES])
    return facts.select("model", F.explode(rows).alias("r")).select("model", "r.attr", "r.value")


def model_arch(facts: DataFrame) -> DataFrame:
    """Info row ``(model, arch, dtype, value=1)`` where either is known."""
    return facts.where((F.col("arch") != "") | (F.col("dtype") != "")).select(
        "model", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c) for c in ("arch", "dtype")],
        F.lit(1.0).alias("value"))

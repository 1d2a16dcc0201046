"""Server log lines -> severities, rate limits, cache gauges and crash reasons.

Lines are ``(source, seq, byte_offset, ts, line)``.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved
from .slices import across, carry_forward, join_on, micros, previous_row, sliced
from .stats import zero_fill

# Ordered line patterns; the first match decides.
CLASSIFIERS = (
    (r"\[METAL\]|Command buffer execution failed|kIOGPUCommandBuffer|GPU error|METAL command buffer"
     r"|Execution of the command buffer", True, "error", "gpu"),
    (r"\[WARN\]|Node with rank|rank\s+\d+.*(failed|down|offline)|exited with code|Lost connection|peer.*closed",
     True, "warning", "rank"),
    (r"\b(Traceback|Fatal Python error|SIGABRT|SIGSEGV|SIGKILL|segmentation fault|KeyboardInterrupt|killed"
     r"|OutOfMemory|CUDA|MLX error|RuntimeError)\b", True, "error", "python"),
    (r"\b(error|failed|fault)\b", True, "error", "python"),
    (r"\b(tokens/s|ttft|gen:.*ms|generation|prefill|prompt cache|prompt processing|processing progress"
     r"|cache sequence|context length|kv cache)\b", True, "info", "generation"),
    (r"(POST|GET|DELETE|PUT) /", False, "info", "http"),
)
FALLBACK = ("info", "other")
SEVERITY_NUMBER = {"debug": 1, "info": 9, "warning": 13, "error": 17, "fatal": 21}
DEFAULT_SEVERITY = 9
CRASH_PATTERNS = (
    (r"\[METAL\].*(Command buffer execution failed|GPU errors)", "metal_gpu_error"),
    (r"\[METAL\].*(reset|timeout|out of memory)", "metal_gpu_error"),
    (r"\b(out of memory|OOM|allocation failed)\b", "oom"),
    (r"\b(traceback|killed|segmentation fault|SIGABRT)\b", "python_error"),
)
CRASH_REASONS = ("metal_gpu_error", "oom", "python_error", "exit", "unknown")
TAIL_BYTES = 8192
CACHE_TOTAL = r"Prompt Cache:\s+(\d+)\s+sequences?,\s+([\d.]+)\s+GB"
CACHE_TYPE = r"-\s+(\w+):\s+(\d+)\s+sequences?,\s+([\d.]+)\s+GB"
CACHE_TYPES = ("total", "assistant", "user", "system")
CACHE_SEQUENCES = 10
BUCKET_CAPACITY = 50.0


def _flags(ignore_case: bool) -> str:
    # (U) Unicode classes, (d) only \n ends a line
    return "(?iUd)" if ignore_case else "(?Ud)"


def clean_lines(df: DataFrame) -> DataFrame:
    """Drop the trailing carriage return and empty lines."""
    return df.withColumn("line", F.regexp_replace("line", r"\r+$", "")).where(F.col("line") != "")


def classify_lines(df: DataFrame) -> DataFrame:
    """Add ``severity`` and ``category``; one scan, no shuffle."""
    hit = F.struct(F.lit(FALLBACK[0]).alias("s"), F.lit(FALLBACK[1]).alias("c"))
    for pattern, ignore_case, severity, category in reversed(CLASSIFIERS):
        hit = F.when(F.col("line").rlike(_flags(ignore_case) + pattern),
                     F.struct(F.lit(severity).alias("s"), F.lit(category).alias("c"))).otherwise(hit)
    return df.withColumn("_h", hit).withColumns({"severity": F.col("_h.s"), "category": F.col("_h.c")}).drop("_h")


def severity_number(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_NUMBER.items() for x in kv])
    return F.coalesce(table[severity], F.lit(DEFAULT_SEVERITY))


def drop_noise_lines(classified: DataFrame, include_http: bool = False) -> DataFrame:
    """Lines that stay after the access-log filter."""
    return classified if include_http else classified.where(F.col("category") != "http")


def dropped_counts(limited: DataFrame, include_http: bool = False) -> DataFrame:
    """``(reason, n)`` for lines dropped by the filter or by the rate limit."""
    reason = F.when(F.lit(not include_http) & (F.col("category") == "http"), "http_filter")
    if "accepted" in limited.columns:
        reason = F.coalesce(reason, F.when(~F.col("accepted"), "rate_limit"))
    return limited.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


def line_counts(classified: DataFrame, step: int) -> DataFrame:
    """Lines per time bucket, severity and category."""
    t = (F.floor(micros("ts") / (step * 1_000_000)) * step).cast("bigint").alias("t")
    return classified.groupBy(t, "severity", "category").agg(F.count(F.lit(1)).alias("n"))


class TokenBucket:
    """Token bucket over arrival times in whole nanoseconds.

    Its state is one number, the time at which it would be full again: taking a token moves that
    on by the cost of a token, and a line is accepted while a token is left.  Integers keep it
    exact, so that a bucket carried over a cut equals one that was never cut.
    """

    def __init__(self, rate: float, full_at: int | None = None):
        self.rate = max(rate, 0.0)
        self.cost = round(1e9 / self.rate) if self.rate else 0
        #: How far ahead the bucket may be from full and still hold a token.
        self.slack = round((max(self.rate, BUCKET_CAPACITY) - 1) * self.cost)
        self.full_at = full_at
        self.last_full = None

    @property
    def refill(self) -> int:
        """Nanoseconds after which the bucket is full, whatever its state."""
        return self.slack + self.cost

    def take(self, nanos: np.ndarray) -> np.ndarray:
        """Which lines are accepted; ``last_full`` is the last arrival that found the bucket full."""
        ok = np.ones(len(nanos), dtype=bool)
        if not self.rate or not len(nanos):
            return ok
        full_at, cost, slack = self.full_at, self.cost, self.slack
        if full_at is None:
            full_at = int(nanos[0])
        for i, now in enumerate(nanos.tolist()):
            if full_at <= now:
                self.last_full = now
                full_at = now + cost
            elif full_at - now <= slack:
                full_at += cost
            else:
                ok[i] = False
        self.full_at = full_at
        return ok


def rate_limit(df: DataFrame, rate: float, slice_seconds: int = 3600) -> DataFrame:
    """Token bucket per source: adds ``accepted``; ``rate`` 0 accepts everything.

    A source is cut into time slices that run at the same time, each from a guessed
    bucket.  The first guess is an empty bucket; after that it is what the slice before left, brought into
    step with the last arrival that found the bucket full, since a busy bucket keeps
    that arrival's time modulo the cost of a token.  Slices whose guess was wrong run again until all agree
    with their neighbours: two or three rounds in practice, one per slice at worst, and the
    result is that of one bucket per source.  Only ``(source, seq, us)`` goes to Python, in sorted batches; a
    slice is streamed, never held.  Rows without a source share one bucket.
    """
    if rate <= 0:
        return df.withColumn("accepted", F.lit(True))
    made = TokenBucket(rate)
    key = ["source", "slice"]
    slim = df.select("source", "seq", micros("ts").alias("us")).withColumn("slice", F.floor(F.col("us") / (slice_seconds * 1_000_000)).cast("bigint"))
    slim = saved(slim, "bucket-lines")
    seq = Window.partitionBy("source").orderBy("slice")
    first = slim.groupBy(*key).agg(F.min("us").alias("us"))
    empty = F.col("us") * 1000 + made.refill
    todo = first.select(*key, F.when(F.row_number().over(seq) > 1, empty).alias("start"))
    known = None
    while True:
        ran = _bucket_slices(slim, todo, rate, False)
        if known is not None:
            ran = ran.unionByName(known.where("not again").select(*key, "start", "end", "full"))
        ran = saved(ran, "bucket-slices")
        before = F.lag("end").over(seq)
        full = F.last("full", ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, -1))
        fits = before - F.coalesce(F.pmod(before - full, F.lit(made.cost)), F.lit(0))
        known = ran.withColumns({"before": before, "fits": fits}).withColumn("again", F.coalesce(F.col("before") != F.col("start"), F.lit(False)))
        known = saved(known.withColumn("want", F.when(F.col("fits") != F.col("start"), F.col("fits")).otherwise(F.col("before"))), "bucket-slices")
        if not known.where("again").limit(1).count():
            break
        todo = known.where("again").select(*key, F.col("want").alias("start"))
    decided = _bucket_slices(slim, known.select(*key, "start"), rate, True)
    return join_on(df, decided, ["source", "seq"])


def _bucket_slices(lines: DataFrame, starts: DataFrame, rate: float, decide: bool) -> DataFrame:
    """Buckets run over slices from their starts: decisions, or (source, slice, start, end, full) in nanoseconds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, last, head = None, None, None
        for b in batches:
            us = b["us"].to_numpy()
            if not len(us):
                continue
            if (last is not None and us[0] < last) or (np.diff(us) < 0).any():
                raise ValueError("lines of a source must arrive in time order")
            last = us[-1]
            if bucket is None:
                head = b.iloc[0]
                bucket = TokenBucket(rate, None if pd.isna(head["start"]) else int(head["start"]))
            ok = bucket.take(us * 1000)
            if decide:
                yield pd.DataFrame({"source": b["source"], "seq": b["seq"], "accepted": ok})
        if bucket is not None and not decide:
            numbers = {"start": None if pd.isna(head["start"]) else int(head["start"]), "end": bucket.full_at, "full": bucket.last_full}
            yield pd.DataFrame({"source": [head["source"]], "slice": [head["slice"]], **{k: pd.array([v], "Int64") for k, v in numbers.items()}})

    d = join_on(lines, starts, ["source", "slice"])
    ordered = d.select("source", "slice", "us", "seq", F.col("start").cast("string").alias("start")).repartition("source", "slice").sortWithinPartitions("source", "slice", "us", "seq")
    kind = "source string, seq bigint, accepted boolean" if decide else "source string, slice bigint, start bigint, end bigint, full bigint"
    return ordered.groupBy("source", "slice").applyInPandas(run, kind)


def kv_cache_blocks(lines: DataFrame) -> DataFrame:
    """Last cache-statistics block per source: ``(source, type, sequences, bytes)``.

    A total line opens a block; type lines after it belong to it (type lines
    before any total count too).  Only the four known types are reported, with
    zeros for those that are missing.
    """
    seen = _cache_lines(lines)
    opened = seen.groupBy("source").agg(F.max(F.when(F.col("type") == "total", F.col("seq"))).alias("_open"))
    block = seen.join(opened, "source").where(F.col("_open").isNull() | (F.col("seq") >= F.col("_open")))
    last = block.groupBy("source", "type").agg(F.max_by(F.struct("sequences", "bytes"), "seq").alias("v"))
    # zero-filled dimension
    dim = lines.select("source").distinct().withColumn(
        "type", F.explode(F.array(*[F.lit(x) for x in CACHE_TYPES])))
    return dim.join(last, ["source", "type"], "left").select(
        "source", "type", F.coalesce("v.sequences", F.lit(0)).alias("sequences"),
        F.coalesce("v.bytes", F.lit(0.0)).alias("bytes"))


def _cache_lines(lines: DataFrame) -> DataFrame:
    total, kind = "(?Ud)" + CACHE_TOTAL, "(?Ud)" + CACHE_TYPE
    is_total = F.col("line").rlike(total)
    d = lines.where(is_total | F.col("line").rlike(kind))

    def pick(i_total, i_type, typ):
        return F.when(is_total, F.regexp_extract("line", total, i_total)).otherwise(
            F.regexp_extract("line", kind, i_type)).try_cast(typ)

    return d.select("source", "seq", F.when(is_total, "total").otherwise(F.regexp_extract("line", kind, 1)).alias("type"),
                    pick(1, 2, "bigint").alias("sequences"), (pick(2, 3, "double") * 1e9).alias("bytes"))


def kv_utilization(lines: DataFrame, full_context_bytes: Column, sequences: int = CACHE_SEQUENCES) -> DataFrame:
    """Cache bytes over capacity; the largest type stands in for a missing total."""
    seen = _cache_lines(lines)
    opened = seen.groupBy("source").agg(F.max(F.when(F.col("type") == "total", F.col("seq"))).alias("_open"))
    block = seen.join(opened, "source").where(F.col("_open").isNull() | (F.col("seq") >= F.col("_open")))
    last = block.groupBy("source", "type").agg(F.max_by("bytes", "seq").alias("bytes"))
    per = last.groupBy("source").agg(F.max(F.when(F.col("type") == "total", F.col("bytes"))).alias("_t"),
                                     F.max("bytes").alias("_m"))
    used = F.when(F.coalesce(F.col("_t"), F.lit(0.0)) != 0, F.col("_t")).otherwise(F.col("_m"))
    cap = F.lit(sequences) * full_context_bytes
    return per.select("source", used.alias("used_bytes"),
                      F.when(cap > 0, used / cap).otherwise(F.lit(0.0)).alias("utilization"))


def crash_reason(exits: DataFrame, lines: DataFrame, nbytes: int = TAIL_BYTES) -> DataFrame:
    """Reason of each exit from the last ``nbytes`` of its log before the exit.

    Both sides are cut into byte buckets, joined by equality and checked for
    overlap.  Only lines that match a pattern take part.  Default ``exit``; a
    source without a log gives ``unknown``.
    """
    def priority(text):
        p = F.lit(None).cast("int")
        for i, (pattern, _) in reversed(list(enumerate(CRASH_PATTERNS))):
            p = F.when(text.rlike(_flags(True) + pattern), F.lit(i)).otherwise(p)
        return p

    size = F.octet_length("line")
    hits = lines.where(priority(F.col("line")).isNotNull()).select(
        "source", F.col("byte_offset").alias("lo"), (F.col("byte_offset") + size).alias("hi"), "line")
    hits = hits.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / nbytes), F.floor(F.col("hi") / nbytes))))
    ex = exits.withColumn("_from", F.greatest(F.col("byte_offset") - nbytes, F.lit(0)))
    probe = ex.select("source", "exit_id", "_from", F.col("byte_offset").alias("_to"), F.explode(
        F.sequence(F.floor(F.col("_from") / nbytes), F.floor(F.col("byte_offset") / nbytes))).alias("_b"))
    cut = F.greatest(F.col("_from") - F.col("lo"), F.lit(0)).cast("int")
    # the tail may begin inside a line
    tail = F.substring(F.col("line").cast("binary"), cut + 1, size).cast("string")
    found = (probe.join(hits, ["source", "_b"]).where((F.col("lo") < F.col("_to")) & (F.col("hi") > F.col("_from")))
             .withColumn("p", priority(tail)).groupBy("source", "exit_id").agg(F.min("p").alias("p")))
    names = F.array(*[F.lit(r) for _, r in CRASH_PATTERNS])
    known = lines.select("source").distinct().withColumn("_log", F.lit(True))
    return (exits.join(found, ["source", "exit_id"], "left").join(known, "source", "left")
            .withColumn("reason", F.when(F.col("_log").isNull(), "unknown")
                        .when(F.col("p").isNotNull(), F.element_at(names, F.col("p") + 1)).otherwise("exit"))
            .drop("p", "_log"))


def crash_ledger(reasoned: DataFrame) -> DataFrame:
    """Crashes per hour and reason, every reason present in every hour that had a crash."""
    hour = F.date_trunc("hour", "ts")
    facts = reasoned.groupBy(hour.alias("hour"), "reason").agg(F.count(F.lit(1)).alias("crashes"))
    dim = reasoned.select(hour.alias("hour")).distinct().withColumn(
        "reason", F.explode(F.array(*[F.lit(r) for r in CRASH_REASONS])))
    return zero_fill(dim, facts, ["hour", "reason"], ["crashes"])


def restarts_per_hour(reasoned: DataFrame) -> DataFrame:
    return reasoned.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("restarts"))


def last_crash_reason(reasoned: DataFrame, by: str = "source") -> DataFrame:
    """One row per source and reason: 1 for the reason of the latest crash, else 0."""
    last = reasoned.groupBy(by).agg(F.max_by("reason", F.struct("ts", "exit_id")).alias("_r"))
    return (last.withColumn("reason", F.explode(F.array(*[F.lit(r) for r in CRASH_REASONS])))
            .select(by, "reason", F.when(F.col("reason") == F.col("_r"), 1.0).otherwise(0.0).alias("value")))


def probe_outcomes(probes: DataFrame, by: list[str] = (), factor: float = 6.0, eps: float = 0.01) -> DataFrame:
    """ok / fail counts and whether failures dominate."""
    ok, fail = (F.coalesce(F.sum(F.when(F.col("result") == r, 1).otherwise(0)), F.lit(0)) for r in ("ok", "fail"))
    d = probes.groupBy(*by).agg(ok.alias("ok"), fail.alias("fail"))
    return d.withColumn("failing", F.col("fail") > factor * (F.col("ok") + eps))


def serving_states(events: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """State after each event: 0 idle, 1 running, 2 starting/degraded, 3 back-off.

    ``events`` is ``(source, ts, seq, event)`` with spawn, exit, ok, fail, stop.
    A spawn starts (2); a good probe of a live process means running (1); a bad
    probe degrades a running one (2); the first exit restarts at once, later
    ones back off (3); stop is idle (0).

    Inside a time slice an event's effect depends on what came before the slice in two points only:
    whether there was an exit, and whether the process was alive.  So every event gets its effect for the four
    cases, a slice's summary keeps the last one of each, and the summaries decide which case holds: events are read twice.
    """
    e, n = F.col("event"), slice_seconds * 1_000_000
    order = ["us", "seq"]
    d = sliced(events.withColumn("us", micros("ts")), ["source"], F.col("us"), n)
    inner = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    life = F.when(e == "spawn", 1).when(e.isin("exit", "stop"), 0)
    d = d.withColumns({"_exits": F.sum(F.when(e == "exit", 1).otherwise(0)).over(inner), "_alive": F.last(life, ignorenulls=True).over(inner), "_life": life})

    def effect(exited: int, alive: int) -> Column:
        return (F.when(e == "spawn", 2).when(e == "stop", 0).when((e == "exit") & (F.col("_exits") + exited > 1), 3)
                .when((e == "ok") & (F.coalesce("_alive", F.lit(alive)) == 1), 1))

    cases = [f"_case{i}" for i in range(4)]
    d = d.withColumns({c: F.when(effect(i // 2, i % 2).isNotNull(), F.struct("us", "seq", effect(i // 2, i % 2).alias("v"))) for i, c in enumerate(cases)})
    d = d.withColumn("_bad", F.when(e == "fail", F.struct("us", "seq")))
    latest = F.struct("us", "seq")
    per = d.groupBy("_key").agg(
        F.max("_exits").alias("_exits"), F.max_by("_life", F.when(F.col("_life").isNotNull(), latest)).alias("_life"),
        *[F.max(c).alias(c) for c in cases], F.max("_bad").alias("_bad"))
    prior = across(["source"]).rowsBetween(Window.unboundedPreceding, -1)
    exited = F.coalesce(F.sum("_exits").over(prior), F.lit(0)) > 0
    alive = F.coalesce(F.last("_life", ignorenulls=True).over(prior), F.lit(0))
    per = per.withColumn("_i", (exited.cast("int") * 2 + alive).cast("int"))
    chosen = F.get(F.array(*cases), F.col("_i"))
    carry = per.withColumn("_set", chosen).select(
        "_key", "_i", F.last("_set", ignorenulls=True).over(prior).alias("_set0"), F.last("_bad", ignorenulls=True).over(prior).alias("_bad0"))
    d = d.join(carry, "_key")
    d = d.withColumns({"_at": F.coalesce(F.last(chosen, ignorenulls=True).over(inner), F.col("_set0")),
                       "_fail": F.coalesce(F.last("_bad", ignorenulls=True).over(inner), F.col("_bad0"))})
    degraded = (F.col("_at.v") == 1) & (F.col("_fail") > F.struct(F.col("_at.us").alias("us"), F.col("_at.seq").alias("seq")))
    return d.select("source", "ts", "seq", "event",
                    F.when(F.coalesce(degraded, F.lit(False)), 2).otherwise(F.coalesce("_at.v", F.lit(0))).alias("state"))


def cascade_origin(exits: DataFrame, gap: float, by: list[str] = (), slice_seconds: int = 86400) -> DataFrame:
    """Which node exited first in each crash cluster.

    Exits closer than ``gap`` seconds to the one before belong together.
    ``(by.., cluster_start, first_node, first_code, exits, nodes)``.
    """
    by = list(by)
    d = exits.withColumn("us", micros("ts"))
    order, rank, pos, n = ["us", "exit_id"], F.struct("us", "exit_id"), F.col("us"), slice_seconds * 1_000_000
    d = previous_row(d, by, order, {"_before": "us"}, pos, n, rank)
    d = d.withColumn("_start", F.when(F.col("_before").isNull() | (F.col("us") - F.col("_before") > gap * 1e6), F.col("us")))
    d = carry_forward(d, by, order, {"cluster_start": "_start"}, pos, n, rank)
    return d.groupBy(*by, "cluster_start").agg(
        F.min_by("node", rank).alias("first_node"), F.min_by("exit_code", rank).alias("first_code"),
        F.count(F.lit(1)).alias("exits"), F.count_distinct("node").alias("nodes"))

"""Labelled samples -> instant vectors, rates, increases and averages.

Samples are ``(metric, labels MAP, ts, value)``.  A *vector* is a DataFrame
``(t BIGINT epoch seconds, <label columns>, value DOUBLE)``.

Work is done once per ``(series, bucket)``: :func:`counter_increments`,
:func:`value_rollup` and :func:`gauge_rollup` reduce raw samples to rows per
series and resolution bucket, and every window length reads that small table.
Window sums use a difference array (add at ``b``, subtract at ``b + w``, running
total), so a 30-day window costs the same as a 5-minute one.  Sums are exact
(:mod:`exactsum`): rollups have a row per band of magnitude, almost always one,
and a window that has drained is exactly zero.

A rollup's own columns are ``t`` and those that start with ``_``; all others are labels.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exactsum as X
from .slices import dealt, micros

SERIES = "series"


@dataclass(frozen=True)
class Grid:
    """Evaluation times, all multiples of ``step`` seconds since the epoch."""

    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.step <= 0 or self.start % self.step or self.end % self.step:
            raise ValueError("grid bounds must be multiples of step")

    def frame(self, spark: SparkSession) -> DataFrame:
        n = (self.end - self.start) // self.step + 1
        return spark.range(n).select((F.lit(self.start) + F.col("id") * self.step).alias("t"))


def normalise_labels(labels: Column) -> Column:
    """Series identity text: label pairs in key order."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(labels))))


def label_pairs(labels: Column) -> Column:
    """Label pairs in key order, equal where :func:`normalise_labels` is, which costs more per sample; :func:`pairs_text` makes the text of them."""
    some_null = F.get(F.sort_array(F.map_values(labels)), F.lit(0)).isNull()  # nulls come first; the text leaves them out
    without = F.from_json(F.to_json(labels), "map<string,string>")
    return F.sort_array(F.map_entries(F.when(some_null & (F.size(labels) > 0), without).otherwise(labels)))


def pairs_text(pairs: Column) -> Column:
    """The series identity text of :func:`label_pairs`."""
    return F.to_json(F.map_from_entries(pairs))


def matcher(labels: Column, eq: dict | None = None, re: dict | None = None) -> Column:
    """Label matchers ``=`` and anchored ``=~``; a missing label reads as ''."""
    cond = F.lit(True)
    for k, v in (eq or {}).items():
        cond = cond & (F.coalesce(labels[k], F.lit("")) == F.lit(v))
    for k, v in (re or {}).items():
        cond = cond & F.coalesce(labels[k], F.lit("")).rlike(f"^(?:{v})$")
    return cond


def select_series(samples: DataFrame, metric: str, labels: list[str] = (), eq: dict | None = None,
                  re: dict | None = None) -> DataFrame:
    """Samples of one metric with chosen labels promoted to columns.

    The metric test is a plain column predicate, so it prunes partitions of a
    table written by ``sources.write_samples``.
    """
    lab = F.col("labels")
    return (samples.where(F.col("metric") == metric).where(matcher(lab, eq, re))
            .select(normalise_labels(lab).alias(SERIES),
                    *[F.coalesce(lab[n], F.lit("")).alias(n) for n in labels], "ts", "value"))


def bind_variables(params: dict[str, str | list | None]) -> dict[str, str]:
    """Dashboard variables -> regex matchers; ``All``/None matches everything."""
    out = {}
    for k, v in params.items():
        if v is None or v in ("All", "$__all"):
            out[k] = ".*"
        elif isinstance(v, (list, tuple)):
            out[k] = "|".join(_escape(x) for x in v)
        else:
            out[k] = _escape(v)
    return out


def _escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def label_values(samples: DataFrame, metric: str, label: str, eq: dict | None = None,
                 re: dict | None = None) -> DataFrame:
    """Distinct non-empty values of a label."""
    return (samples.where(F.col("metric") == metric).where(matcher(F.col("labels"), eq, re))
            .select(F.col("labels")[label].alias(label))
            .where(F.coalesce(F.col(label), F.lit("")) != "").distinct())


def dedup_sources(samples: DataFrame, prefer: list[str], label: str = "job") -> DataFrame:
    """Keep one copy of a sample that several jobs deliver, by preference order."""
    rest = F.map_filter("labels", lambda k, _: k != label)
    pref = F.array_position(F.array(*[F.lit(p) for p in prefer]), F.col("labels")[label])
    return (samples.groupBy("metric", normalise_labels(rest).alias("_k"), "ts")
            .agg(F.min_by(F.struct("labels", "value"),
                          F.struct(F.when(pref == 0, F.lit(len(prefer) + 1)).otherwise(pref).alias("p"),
                                   F.coalesce(F.col("labels")[label], F.lit("")).alias("j"))).alias("_s"))
            .select("metric", F.col("_s.labels").alias("labels"), "ts", F.col("_s.value").alias("value")))


def bucket_end(ts: str, res: int) -> Column:
    """Smallest multiple of ``res`` seconds at or after the sample time."""
    us = micros(ts)
    return ((us + F.pmod(-us, F.lit(res * 1_000_000))) / 1_000_000).cast("bigint")


def _keys(df: DataFrame, by: list[str] | None) -> list[str]:
    return [c for c in df.columns if c not in ("ts", "value")] if by is None else list(by)


def labels_of_rollup(rollup: DataFrame) -> list[str]:
    """The label columns of a rollup."""
    return [c for c in rollup.columns if c != "t" and not c.startswith("_")]


def counter_increments(df: DataFrame, res: int, series: list[str] | None = None,
                       tie: str | None = None) -> DataFrame:
    """Reset-aware increments per (series, bucket): ``(series.., t, _band, _n, _units)``.

    Between two restarts a counter grows by its last value less its first, so that of all samples only the ends of a bucket and
    those around a drop are added up.  The sample before comes from a window over
    ``(series, bucket)``; across buckets from the one-row-per-bucket summary.
    All but that last step share one shuffle by ``(series, bucket)``.  A band may
    have two rows in a bucket; ``_n`` counts the steps.  Samples that are NaN or null are left out; samples of one time
    count from the smallest up.  Growth to +Inf counts as +Inf, and staying there as 0.
    """
    keys = _keys(df, series)
    keys = [k for k in keys if k != tie]
    order = ["ts"] + ([tie] if tie else []) + ["value"]
    d = dealt(df.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("t", bucket_end("ts", res)), *keys, "t")
    here = Window.partitionBy(*keys, "t").orderBy(*order)
    d = d.select(*keys, "t", *order, F.lag("value").over(here).alias("_prev"), F.lead(F.lit(1)).over(here).isNull().alias("_end"),
                 F.row_number().over(here).alias("_i"))
    drop = F.col("value") < F.col("_prev")
    d = d.where(F.col("_prev").isNull() | F.col("_end") | drop)
    d = d.select(*keys, "t", "value", "_prev", "_end", "_i", F.lag("value").over(here).alias("_from"), F.lag("_i").over(here).alias("_at"))
    # What was there before a drop, or at the end, less the first value since the restart, and what there is after a drop.
    upto = F.when(drop, F.col("_prev")).otherwise(F.col("value"))
    steps = F.col("_i") - F.col("_at") - F.when(drop, 1).otherwise(0)
    grown = F.when(steps > 0, F.struct(steps.cast("bigint").alias("_n"), step_increment(upto, F.col("_from")).alias("_inc")))
    anew = F.when(drop, F.struct(F.lit(1).cast("bigint").alias("_n"), F.col("value").alias("_inc")))
    d = d.select(*keys, "t", "value", "_prev", "_end", F.explode(F.array(grown, anew)).alias("_g"))
    d = d.where(F.col("_g").isNotNull() | F.col("_prev").isNull() | F.col("_end"))
    d = d.withColumn("_band", X.band(F.col("_g._inc"))).withColumn("_units", X.units(F.col("_g._inc"), F.col("_band")))
    per = d.groupBy(*keys, "t", "_band").agg(
        F.sum("_g._n").alias("_n"), F.sum("_units").cast(X.UNITS).alias("_units"),
        F.max(F.when(F.col("_end"), F.col("value"))).alias("_top"), F.max(F.when(F.col("_prev").isNull(), F.col("value"))).alias("_first"))
    per = per.groupBy(*keys, "t").agg(
        F.collect_list(F.when(F.col("_band").isNotNull(), F.struct("_band", "_n", "_units"))).alias("_rows"),
        F.max("_top").alias("_top"), F.max("_first").alias("_first"))
    # A bucket's first sample grows from the last one of the bucket before.
    before = F.lag("_top").over(Window.partitionBy(*keys).orderBy("t"))
    per = per.withColumn("_inc", step_increment(F.col("_first"), before)).withColumn("_band", X.band(F.col("_inc")))
    first = F.struct("_band", F.lit(1).cast("bigint").alias("_n"), X.units(F.col("_inc"), F.col("_band")).alias("_units"))
    return per.select(*keys, "t", F.explode(F.concat("_rows", F.array(first))).alias("_r")).select(*keys, "t", "_r.*")


def _banded(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    d = df.withColumn("_band", X.band(value)).withColumn("_units", X.units(value, F.col("_band")))
    return d.groupBy(*keys, "t", "_band").agg(F.count(F.lit(1)).alias("_n"), F.sum("_units").cast(X.UNITS).alias("_units"))


def step_increment(value: Column, prev: Column) -> Column:
    """Growth since the previous sample; a drop means a restart from zero."""
    return F.when(prev.isNull() | (value == prev), F.lit(0.0)).when(value >= prev, value - prev).otherwise(value)


def gauge_rollup(df: DataFrame, res: int, series: list[str] | None = None,
                 tie: str | None = None) -> DataFrame:
    """``(series.., t, _n, _last)`` per (series, bucket), for :func:`instant`; partial aggregation only."""
    keys = [k for k in _keys(df, series) if k != tie]
    rank = F.struct("ts", tie) if tie else F.col("ts")
    return df.withColumn("t", bucket_end("ts", res)).groupBy(*keys, "t").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("value", rank).alias("_last"))


def value_rollup(df: DataFrame, res: int, series: list[str] | None = None) -> DataFrame:
    """Exact sums of sample values: ``(series.., t, _band, _n, _units)``, for :func:`avg_over_time`; partial aggregation only."""
    keys = _keys(df, series)
    return _banded(df.where(F.col("value").isNotNull()).withColumn("t", bucket_end("ts", res)), keys, F.col("value"))


def _spread(df: DataFrame, keys: list[str], lo: Column, hi: Column, grid: Grid, *cols) -> DataFrame:
    """Emit one row per grid time in ``[lo, hi)``."""
    first = F.greatest(lo + F.pmod(-lo, F.lit(grid.step)), F.lit(grid.start))
    last = F.least(hi - 1, F.lit(grid.end))
    d = df.select(*keys, *cols, first.alias("_lo"), last.alias("_hi")).where("_lo <= _hi")
    return d.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(grid.step).cast("bigint"))).alias("t"),
                    *[c for c in d.columns if c not in keys and c not in ("_lo", "_hi")])


def sliding(rollup: DataFrame, keys: list[str], windows: dict[str, int], grid: Grid, label: str | None = None) -> DataFrame:
    """Exact sums of a rollup over ``(t - w, t]`` for one or several windows.

    Returns ``(keys.., [label], t, _n, _parts)`` at the grid times where the window
    holds at least one sample; ``_parts`` is what ``exactsum.total`` reads.  Rows per
    key are bounded by the number of buckets in the covered time range (and bands),
    whatever the number of raw samples.
    """
    run = _running(rollup, keys, windows, grid, ["_n", "_units"], ["_band"])
    out = run.groupBy(*keys, "_w", "t").agg(
        F.sum("_n").alias("_n"), F.collect_list(F.struct(F.col("_band").alias("band"), F.col("_units").alias("units"))).alias("_parts"))
    return out.withColumnRenamed("_w", label) if label else out.drop("_w")


def _running(rollup: DataFrame, keys: list[str], windows: dict[str, int], grid: Grid, cols: list[str], inner: list[str]) -> DataFrame:
    """Windowed sums of ``cols`` per (keys, inner): ``(keys.., _w, inner.., t, cols..)`` on the grid."""
    for w in windows.values():
        if w <= 0:
            raise ValueError("window must be positive")
    pre = rollup.groupBy(*keys, *inner, "t").agg(*[F.sum(c).alias(c) for c in cols])
    parts = []
    for name, w in windows.items():
        parts.append(F.struct(F.lit(name).alias("_w"), F.col("t").alias("t"), *[F.col(c).alias(c) for c in cols]))
        parts.append(F.struct(F.lit(name).alias("_w"), (F.col("t") + w).alias("t"),
                              *[(-F.col(c)).alias(c) for c in cols]))
    ev = pre.select(*keys, *inner, F.explode(F.array(*parts)).alias("e")).select(*keys, *inner, "e.*")
    k = [*keys, "_w"]
    net = ev.groupBy(*k, *inner, "t").agg(*[F.sum(c).alias(c) for c in cols])
    if inner:  # dealt by the outer keys, so that the window and what follows share one shuffle
        net = net.repartition(*k)
    seq = Window.partitionBy(*k, *inner).orderBy("t")
    upto = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = net.select(*k, *inner, "t", F.lead("t").over(seq).alias("_next"),
                     *[F.sum(c).over(upto).alias(c) for c in cols]).where("_n > 0")
    return _spread(run, [*k, *inner], F.col("t"), F.col("_next"), grid, *cols)


def covered(seen: DataFrame, keys: list[str], window: int, grid: Grid) -> DataFrame:
    """Grid times with a row of ``seen`` (``keys.., t``) in ``(t - window, t]``: ``(keys.., t)``."""
    return _running(seen.withColumn("_n", F.lit(1)), keys, {"w": window}, grid, ["_n"], []).select(*keys, "t")


def increase(rollup: DataFrame, window: int, grid: Grid, by: list[str] | None = None) -> DataFrame:
    """``sum by (by) (increase(x[window]))``; ``by=None`` keeps every series.

    The rollup is summed by group before the window is applied, so the windowed
    step sees groups rather than series.
    """
    keys = labels_of_rollup(rollup) if by is None else list(by)
    return sliding(rollup, keys, {"w": window}, grid).select("t", *keys, X.total(F.col("_parts")).alias("value"))


def rate(rollup: DataFrame, window: int, grid: Grid, by: list[str] | None = None) -> DataFrame:
    """Per-second form of :func:`increase`."""
    return increase(rollup, window, grid, by).withColumn("value", F.col("value") / F.lit(float(window)))


def avg_over_time(rollup: DataFrame, window: int, grid: Grid, by: list[str] | None = None) -> DataFrame:
    """Mean of the samples in the window, of a :func:`value_rollup`; kept as (sum, count) until the end.

    A NaN, or infinities of both signs, make it NaN; one infinity makes it infinite.
    """
    keys = labels_of_rollup(rollup) if by is None else list(by)
    return sliding(rollup, keys, {"w": window}, grid).select("t", *keys, (X.total(F.col("_parts")) / F.col("_n")).alias("value"))


def instant(rollup: DataFrame, grid: Grid, lookback: int = 300, by: list[str] | None = None) -> DataFrame:
    """Last sample in ``(t - lookback, t]`` per series, of a :func:`gauge_rollup`."""
    keys = labels_of_rollup(rollup) if by is None else list(by)
    nxt = F.lead("t").over(Window.partitionBy(*keys).orderBy("t"))
    d = rollup.select(*keys, "t", F.col("_last").alias("value"), nxt.alias("_next"))
    end = F.least(F.col("t") + lookback, F.coalesce(F.col("_next"), F.col("t") + lookback))
    return _spread(d, keys, F.col("t"), end, grid, "value").select("t", *keys, "value")


def absent_over_time(df: DataFrame, window: int, grid: Grid, res: int | None = None) -> DataFrame:
    """Grid times with no sample in ``(t - window, t]``: ``(t, value=1)``.

    Covered times come from merged coverage, so there is no range join.
    """
    seen = df.select(bucket_end("ts", res or grid.step).alias("t")).distinct()
    cover = covered(seen, [], window, grid)
    return grid.frame(df.sparkSession).join(cover, "t", "left_anti").withColumn("value", F.lit(1.0))


def total_across_resets(rollup: DataFrame) -> DataFrame:
    """Running total per series that survives restarts: ``(series.., t, value)``.

    Every bucket of a series gets all bands that the series has, so that their totals run on side by side.
    """
    keys = labels_of_rollup(rollup)
    series = Window.partitionBy(*keys)
    has = rollup.repartition(*keys) if keys else rollup
    has = has.withColumn("_bands", F.collect_set("_band").over(series))
    has = has.groupBy(*keys, "t", "_band", "_bands").agg(F.sum("_units").cast(X.UNITS).alias("_units"))
    per = has.groupBy(*keys, "t").agg(F.map_from_entries(F.collect_list(F.struct("_band", "_units"))).alias("_m"), F.first("_bands").alias("_bands"))
    one = per.select(*keys, "t", F.explode("_bands").alias("_band"), "_m").withColumn("_units", F.coalesce(F.col("_m")[F.col("_band")], F.lit(0).cast(X.UNITS)))
    upto = Window.partitionBy(*keys, "_band").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = one.select(*keys, "t", F.col("_band").alias("band"), F.sum("_units").over(upto).cast(X.UNITS).alias("units"))
    return run.groupBy(*keys, "t").agg(X.total(F.collect_list(F.struct("band", "units"))).alias("value")).select("t", *keys, "value")


def synthesize_up(samples: DataFrame, targets: DataFrame, grid: Grid, interval: int) -> DataFrame:
    """``up``: 1 if the target delivered in ``(t - interval, t]``, else 0.

    ``targets`` has ``job, instance`` plus label columns and drives the result,
    so a target that never reported still yields zeros.
    """
    lab = F.col("labels")
    seen = (samples.select(lab["job"].alias("job"), lab["instance"].alias("instance"),
                           bucket_end("ts", grid.step).alias("t")).distinct())
    hits = covered(seen, ["job", "instance"], interval, grid).withColumn("value", F.lit(1.0))
    want = targets.withColumn("t", F.explode(F.sequence(
        F.lit(grid.start).cast("bigint"), F.lit(grid.end).cast("bigint"), F.lit(grid.step).cast("bigint"))))
    cols = [c for c in targets.columns]
    return (want.join(hits, ["job", "instance", "t"], "left")
            .select("t", *cols, F.coalesce("value", F.lit(0.0)).alias("value")))


def merge_target_labels(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the static labels of a target (``job, instance, labels MAP``) to its samples."""
    tgt = targets.select(F.col("job").alias("_job"), F.col("instance").alias("_inst"),
                         F.col("labels").alias("_static"))
    lab = F.col("labels")
    joined = samples.join(tgt, (lab["job"] == F.col("_job")) & (lab["instance"] == F.col("_inst")), "left")
    extra = F.coalesce(F.col("_static"), F.create_map().cast("map<string,string>"))
    own = F.map_filter(lab, lambda k, _: ~F.map_contains_key(extra, k))
    return joined.withColumn("labels", F.map_concat(own, extra)).select(*samples.columns)

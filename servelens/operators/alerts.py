"""Alert evaluation: hold times, routing, grouping, inhibition, annotations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector import labels_of

# Routing, grouping and inhibition defaults.
GROUP_LABELS = ("alertname", "node", "model")
GROUP_WAIT = 30
GROUP_INTERVAL = 300
REPEAT_INTERVAL = 14400
RESOLVE_TIMEOUT = 300
ROUTES = (("critical", "oncall"),)
DEFAULT_RECEIVER = "default"
INHIBIT = (
    (("ProxyDown",), ("UpstreamDown", "ThroughputDrop", "InferenceStalled"), ("job",)),
    (("HardwareExporterDown",), ("GPUHighUtilization", "ThermalThrottling", "LoadHigh"), ("node",)),
)


def alert_states(cond: DataFrame, hold: int, interval: int) -> DataFrame:
    """``pending`` from the first true evaluation, ``firing`` once held ``hold`` s.

    ``cond`` has a row only where the condition is true, so a missing grid point
    ends the run.  A series has at most one row per evaluation time.
    """
    keys = labels_of(cond)
    seq = Window.partitionBy(*keys).orderBy("t")
    brk = F.when(F.lag("t").over(seq) == F.col("t") - interval, 0).otherwise(1)
    start = F.last(F.when(F.col("_brk") == 1, F.col("t")), ignorenulls=True).over(
        seq.rowsBetween(Window.unboundedPreceding, 0))
    return (cond.withColumn("_brk", brk).withColumn("active_since", start)
            .withColumn("state", F.when(F.col("t") - F.col("active_since") >= hold, "firing").otherwise("pending"))
            .select("t", *keys, "value", "active_since", "state"))


def alert_intervals(states: DataFrame, interval: int) -> DataFrame:
    """Collapse states to ``(labels.., state, start_t, end_t, value)``; the end is
    the first evaluation at which the state no longer holds."""
    keys = [c for c in labels_of(states) if c not in ("state", "active_since")]
    return states.groupBy(*keys, "active_since", "state").agg(
        F.min("t").alias("start_t"), (F.max("t") + interval).alias("end_t"),
        F.max_by("value", "t").alias("value")).drop("active_since")


def active_alerts(states: DataFrame, by: list[str] = ()) -> DataFrame:
    """Number of firing alerts per time (and severity, node ..)."""
    return states.where(F.col("state") == "firing").groupBy("t", *by).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select("t", *by, "value")


def route_alerts(alerts: DataFrame, routes=ROUTES, default: str = DEFAULT_RECEIVER) -> DataFrame:
    """First matching child route by severity, else the default receiver."""
    target = F.lit(default)
    for severity, receiver in reversed(routes):
        target = F.when(F.col("severity") == severity, F.lit(receiver)).otherwise(target)
    return alerts.withColumn("receiver", target)


def inhibit(intervals: DataFrame, rules=INHIBIT, prefix: str = "", bucket: int = 3600) -> DataFrame:
    """Mute targets while a source with equal labels fires; what is left of a target stays.

    Sources that fire at the same time count once.  A source that is itself muted still mutes, and a
    label that one side lacks reads as ''.
    """
    out = intervals
    for sources, targets, equal in rules:
        src = intervals.where((F.col("state") == "firing")
                              & F.col("alertname").isin([prefix + s for s in sources]))
        src = merge_intervals(src.withColumns({e: F.coalesce(e, F.lit("")) for e in equal}), list(equal))
        hit = F.coalesce(F.col("alertname").isin([prefix + t for t in targets]), F.lit(False))
        out = out.where(~hit).unionByName(subtract_intervals(out.where(hit), src, list(equal), bucket))
    return out


def subtract_intervals(intervals: DataFrame, cover: DataFrame, keys: list[str], bucket: int = 3600) -> DataFrame:
    """The parts of each interval that no interval of ``cover`` with equal keys holds.

    ``intervals`` has ``keys.., start_t, end_t`` and other columns, which its parts keep; equal rows stay
    as many.  ``cover`` must be disjoint per key (:func:`merge_intervals`).  Intervals are half open; empty ones vanish.

    Both sides are cut at multiples of ``bucket`` seconds.  The covers of a (key, bucket) are one row,
    an array of at most ``bucket`` entries, so every piece meets one row and a hot key is dealt out by time;
    parts that go on across a cut are joined again.
    """
    def cut(df):
        first, last = (F.floor(c / bucket).cast("bigint") for c in (F.col("start_t"), F.col("end_t") - 1))
        d = df.where("start_t < end_t").withColumn("_b", F.explode(F.sequence(first, last)))
        return d.withColumns({"_lo": F.greatest("start_t", F.col("_b") * bucket), "_hi": F.least("end_t", (F.col("_b") + 1) * bucket)})

    names = intervals.columns
    key = [F.coalesce(k, F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    on = [f"_k{i}" for i in range(len(keys))] + ["_b"]
    held = cut(cover).select(*key, "_b", "_lo", "_hi").groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi"))).alias("_held"))
    rows = intervals.groupBy(*names).agg(F.count(F.lit(1)).alias("_times"))
    met = cut(rows).select("*", *key).join(held, on, "left")
    holes = F.filter(F.coalesce("_held", F.array().cast("array<struct<_lo:bigint,_hi:bigint>>")),
                     lambda h: (h["_lo"] < F.col("_hi")) & (h["_hi"] > F.col("_lo")))
    edges = F.arrays_zip(F.concat(F.array("_lo"), F.transform(holes, lambda h: h["_hi"])).alias("lo"),
                         F.concat(F.transform(holes, lambda h: h["_lo"]), F.array("_hi")).alias("hi"))
    parts = met.select(*names, "_times", F.explode(F.filter(edges, lambda e: e["lo"] < e["hi"])).alias("_p"))
    seq = Window.partitionBy(*names, "_times").orderBy("_p.lo")
    fresh = F.when(F.lag("_p.hi").over(seq) == F.col("_p.lo"), 0).otherwise(1)
    run = parts.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(seq))
    whole = run.groupBy(*names, "_times", "_run").agg(F.min("_p.lo").alias("_lo"), F.max("_p.hi").alias("_hi"))
    again = whole.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    bounds = {"start_t": F.col("_lo").cast("bigint").alias("start_t"), "end_t": F.col("_hi").cast("bigint").alias("end_t")}
    return again.select(*[bounds.get(n, F.col(n)) for n in names])


def merge_intervals(intervals: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Union of overlapping intervals per key: ``(keys.., start_t, end_t)``.

    Difference array again: +1 at a start, -1 at an end, aggregated before the
    ordered pass.
    """
    ev = intervals.select(*keys, F.explode(F.array(
        F.struct(F.col("start_t").alias("t"), F.lit(1).alias("d")),
        F.struct((F.col("end_t") + gap).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    net = ev.groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    seq = Window.partitionBy(*keys).orderBy("t")
    run = net.withColumn("open", F.sum("d").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("was", F.coalesce(F.lag("open").over(seq), F.lit(0)))
    edges = run.where((F.col("open") > 0) != (F.col("was") > 0))
    edges = edges.withColumn("end_t", F.lead("t").over(seq) - gap)
    return edges.where("open > 0").select(*keys, F.col("t").alias("start_t"), "end_t")


def group_notifications(intervals: DataFrame, by=GROUP_LABELS, wait: int = GROUP_WAIT,
                        interval: int = GROUP_INTERVAL, repeat: int = REPEAT_INTERVAL) -> DataFrame:
    """Notifications per group of firing alerts.

    A group opens with its first alert and flushes ``wait`` seconds later, then
    every ``interval``.  A flush is sent when the set of firing alerts changed
    since the previous flush (new or resolved), or when ``repeat`` has passed
    since the last change or repeat.  A group lives until ``interval`` after its
    last alert resolved.  Returns ``(by.., t, n_firing, n_resolved, reason)``.
    """
    by = list(by)
    fire = intervals.where(F.col("state") == "firing")
    # an alert opens a session when it starts after everything before it has cleared
    seq = Window.partitionBy(*by).orderBy("start_t", "end_t")
    cleared = F.max("end_t").over(seq.rowsBetween(Window.unboundedPreceding, -1)) + interval
    opens = F.when(cleared.isNull() | (F.col("start_t") > cleared), F.col("start_t"))
    ids = fire.withColumn("_open", opens).withColumn(
        "session", F.last("_open", ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    flushes = ids.groupBy(*by, "session").agg(F.max("end_t").alias("end_t")).select(*by, "session", F.explode(F.sequence(
        F.col("session") + wait, F.col("end_t") + interval + wait, F.lit(interval).cast("bigint"))).alias("t"))
    base = F.col("session") + wait

    def slot(c):
        """First flush at or after a time."""
        return F.greatest(base, base + F.ceil((c - base) / F.lit(float(interval))) * interval).cast("bigint")

    marks = ids.select(*by, "session", F.explode(F.array(
        F.struct(slot(F.col("start_t")).alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(slot(F.col("end_t")).alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("m"))
    change = marks.groupBy(*by, "session", F.col("m.t").alias("t")).agg(
        F.sum("m.up").alias("up"), F.sum("m.down").alias("down"))
    key = [*by, "session", "t"]
    d = flushes.join(change, key, "left").na.fill(0, ["up", "down"])
    seq = Window.partitionBy(*by, "session").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({
        "n_firing": F.sum(F.col("up") - F.col("down")).over(seq),
        "n_resolved": F.col("down"),
        "_chg": F.max(F.when((F.col("up") > 0) | (F.col("down") > 0), F.col("t"))).over(seq)})
    every = -(-repeat // interval) * interval
    again = (F.col("n_firing") > 0) & (F.pmod(F.col("t") - F.col("_chg"), F.lit(every)) == 0)
    changed = F.col("t") == F.col("_chg")
    return (d.where(changed | again)
            .select(*by, "t", "n_firing", "n_resolved",
                    F.when(changed & (F.col("n_firing") == 0), "resolved")
                    .when(changed, "changed").otherwise("repeat").alias("reason")))


def flapping_alerts(states: DataFrame, window: int, grid_step: int) -> DataFrame:
    """Alerts ranked by transitions into firing within ``window`` seconds.

    ``(alertname, t, transitions)``: highest count per alert over any window
    that ends at a transition.
    """
    keys = [c for c in labels_of(states) if c not in ("state", "active_since")]
    seq = Window.partitionBy(*keys).orderBy("t")
    rise = (states.withColumn("_p", F.lag(F.struct("t", "state")).over(seq))
            .where((F.col("state") == "firing")
                   & ~F.coalesce((F.col("_p.state") == "firing") & (F.col("_p.t") == F.col("t") - grid_step),
                                 F.lit(False))))
    per = rise.groupBy("alertname", "t").agg(F.count(F.lit(1)).alias("n"))
    span = Window.partitionBy("alertname").orderBy("t").rangeBetween(-(window - 1), 0)
    counted = per.withColumn("transitions", F.sum("n").over(span))
    return counted.groupBy("alertname").agg(
        F.max(F.struct("transitions", (-F.col("t")).alias("t"))).alias("m")).select(
        "alertname", (-F.col("m.t")).alias("t"), F.col("m.transitions").alias("transitions")
    ).orderBy(F.desc("transitions"), "alertname")


def humanize_percentage(c: Column) -> Column:
    """0.9312 -> ``93.12%`` (four significant digits, no trailing zeros)."""
    pct = c * 100
    mag = F.floor(F.log10(F.greatest(F.abs(pct), F.lit(1e-300))))
    unit = F.pow(F.lit(10.0), F.lit(3) - mag)
    text = F.format_string("%.6f", F.round(pct * unit) / unit)
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(pct == 0, F.lit("0%")).otherwise(F.concat(text, F.lit("%")))


def render_annotations(alerts: DataFrame, templates: dict[str, tuple[str, str]]) -> DataFrame:
    """Fill ``summary`` and ``description`` per alert name.

    Templates use ``{label}`` for label columns and ``{value:%.1f}`` or
    ``{value:pct}`` for the value; a label the alert lacks renders as ''.
    """
    out = {}
    for i, field in enumerate(("summary", "description")):
        expr = F.lit(None).cast("string")
        for name, texts in templates.items():
            expr = F.when(F.col("alertname") == name, _fill(texts[i], alerts.columns)).otherwise(expr)
        out[field] = expr
    return alerts.withColumns(out)


def _fill(template: str, columns: list[str]) -> Column:
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        field, rest = rest.split("}", 1)
        parts.append(F.lit(head))
        if field == "value:pct":
            parts.append(humanize_percentage(F.col("value")))
        elif field.startswith("value:"):
            parts.append(F.format_string(field[6:], F.col("value")))
        else:
            parts.append(F.coalesce(F.col(field), F.lit("")) if field in columns else F.lit(""))
    parts.append(F.lit(rest))
    return F.concat(*parts)

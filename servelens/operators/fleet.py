"""Fleet status: agents up, degraded, down or silent."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severity order and the silence that counts as no data.
RANK = {"up": 0, "degraded": 1, "unknown": 2, "down": 3}
NO_DATA_SECONDS = 180


def status_rank(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[status]


def agent_status(latest: DataFrame, at: Column, silent_after: int = NO_DATA_SECONDS) -> DataFrame:
    """Status per agent from its last sample.

    ``latest`` is ``(node, role, last_ts, up, healthy)``, one row per expected
    agent with nulls for agents never seen.  No sample within ``silent_after``
    seconds: ``unknown`` when the whole node is silent, else ``down``.  Reporting
    but not up: ``down``.  Up but unhealthy: ``degraded``.
    """
    fresh = F.coalesce((F.unix_micros(at) - F.unix_micros("last_ts")) / 1e6 < silent_after, F.lit(False))
    d = latest.withColumn("_fresh", fresh)
    node = d.groupBy("node").agg(F.max("_fresh").alias("_node_alive"))
    status = (F.when(~F.col("_fresh") & ~F.col("_node_alive"), "unknown").when(~F.col("_fresh"), "down")
              .when(F.coalesce("up", F.lit(0.0)) != 1, "down")
              .when(F.coalesce("healthy", F.lit(1.0)) != 1, "degraded").otherwise("up"))
    return d.join(node, "node").withColumn("status", status).drop("_fresh", "_node_alive")


def status_kpis(agents: DataFrame) -> DataFrame:
    """Counts by status, nodes online, models served by agents that are online, share up, needing action."""
    n = {s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)) for s in RANK}
    live = F.when(F.col("status").isin("up", "degraded"), F.col("node"))
    return agents.agg(*[v.alias(s) for s, v in n.items()], F.count_distinct(live).alias("nodes_online"),
                      F.count_distinct(F.when(F.col("status").isin("up", "degraded"), F.col("model"))).alias("models"),
                      F.bround(100.0 * n["up"] / F.count(F.lit(1)), 0).alias("percent_up"),
                      (n["down"] + n["degraded"] + n["unknown"]).alias("needs_action"))


def status_heatmap(states: DataFrame, step: int = 60) -> DataFrame:
    """``(node, t, status, ...)`` -> worst state per node and step: ``(node, t, status)``."""
    worst = F.max_by("status", status_rank(F.col("status")))
    t = (F.floor(F.col("t") / step) * step).cast("bigint")
    return states.groupBy("node", t.alias("t")).agg(worst.alias("status"))


def minutes_impacted(heat: DataFrame) -> DataFrame:
    """Steps per node that were not up, and the current state."""
    return heat.groupBy("node").agg(F.sum(F.when(F.col("status") != "up", 1).otherwise(0)).alias("impacted"),
                                    F.max_by("status", "t").alias("current"))


def role_matrix(agents: DataFrame) -> DataFrame:
    """Agents up and expected per role."""
    return agents.groupBy("role").agg(F.sum(F.when(F.col("status") == "up", 1).otherwise(0)).alias("up"),
                                      F.count(F.lit(1)).alias("expected"))


def role_pivot(agents: DataFrame, nodes: list[str]) -> DataFrame:
    """Role by node grid of states; the node list is given, so no extra pass."""
    return agents.groupBy("role").pivot("node", nodes).agg(F.first("status"))


def open_problems(states: DataFrame, step: int, at: int) -> DataFrame:
    """Agents not up at ``at``: state and how long the outage has lasted.

    ``states`` is ``(node, role, t, status)`` on a grid of ``step`` seconds.
    """
    seq = Window.partitionBy("node", "role").orderBy("t")
    bad = states.where(F.col("t") <= at).withColumn("_bad", F.col("status") != "up")
    good_before = F.last(F.when(~F.col("_bad"), F.col("t")), ignorenulls=True).over(
        seq.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("t").over(Window.partitionBy("node", "role"))
    d = bad.withColumns({"_good": good_before, "_first": first}).where((F.col("t") == at) & F.col("_bad"))
    since = F.coalesce(F.col("_good") + step, F.col("_first"))
    return d.select("node", "role", "status", (F.lit(at) - since).cast("bigint").alias("outage_seconds"))


def problem_kpis(problems: DataFrame, restarts: DataFrame, at: int, window: int = 3600) -> DataFrame:
    """Figures above the list of open problems, in one row.

    ``problems`` as of :func:`open_problems`; ``restarts`` is ``(node, ts)``.  Agents that need action, restarts in the
    ``window`` seconds before ``at`` and on how many nodes, and the oldest outage with its agent (ties by name; null without any).
    """
    us = F.unix_micros("ts")
    recent = restarts.where((us > (at - window) * 1_000_000) & (us <= at * 1_000_000)).agg(
        F.count(F.lit(1)).alias("restarts"), F.count_distinct("node").alias("nodes_restarted"))
    old = F.min(F.struct((-F.col("outage_seconds")).alias("s"), "node", "role"))
    now = problems.agg(F.count(F.lit(1)).alias("needs_action"), old.alias("o"))
    # two tables of one row each
    both = now.withColumn("_r", recent.select(F.struct("restarts", "nodes_restarted")).scalar())
    return both.select("needs_action", "_r.restarts", "_r.nodes_restarted", (-F.col("o.s")).alias("oldest_outage_seconds"),
                       F.col("o.node").alias("oldest_node"), F.col("o.role").alias("oldest_role"))

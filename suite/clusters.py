"""Structural drift between two dumps and fleet status."""

from pyspark.sql import functions as F

from servelens.operators import drift as D
from servelens.operators import fleet as FL
from servelens.operators import stats as ST
from servelens.scratch import fresh_folder
from servelens.sources import readers as RD

from .adapters import EV, T0, events, table
from .registry import query

KINDS = "CASE p_partkey % 4 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'ServiceAccount' WHEN 2 THEN 'ConfigMap' ELSE 'Secret' END"
PLURAL = "CASE p_partkey % 4 WHEN 0 THEN 'deployments' WHEN 1 THEN 'serviceaccounts' WHEN 2 THEN 'configmaps' ELSE 'secrets' END"


def resources(spark, sf, side):
    """``part`` rows as resources.  Side b drops some, adds some and changes sizes."""
    p = table(spark, sf, "part")
    i = F.col("p_partkey")
    if side == "b":
        extra = p.where(i % 11 == 0).withColumn("p_name", F.concat(F.lit("new "), "p_name"))
        p = p.where(i % 7 != 0).withColumn("p_size", F.when(i % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).unionByName(extra)
    meta = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("namespace"), F.lit(side).alias("uid"),
                    F.struct(F.lit(side).alias("deployment.kubernetes.io/revision"),
                             F.when(i % 3 == 0, F.col("p_type")).alias("note")).alias("annotations"))
    gone = F.lit(side == "b") & (i % 15 == 0)
    ab = F.array(*[F.struct(F.lit(n).alias("name"), F.col("p_type").alias("image")) for n in ("a", "b")])
    flip = F.lit(side == "b") & (i % 9 == 0)
    spec = F.struct(F.col("p_size").alias("size"), F.when(~gone, F.struct(F.col("p_retailprice").alias("price"), F.lit(1).alias("tier"))).alias("cost"),
                    F.when(flip, F.reverse(ab)).otherwise(ab).alias("containers"))
    data = F.when(i % 4 == 3, F.struct(F.base64(F.col("p_type").cast("binary")).alias("token")))
    doc = F.to_json(F.struct(meta.alias("metadata"), spec.alias("spec"), F.lit(side).alias("status"), data.alias("data")))
    return p.select(F.lit(side).alias("source"), F.expr(KINDS).alias("kind"), F.col("p_brand").alias("ns"),
                    F.concat_ws("-", "p_name", i.cast("string")).alias("name"), doc.alias("doc"))


def states(spark, sf):
    return D.normalize_resources(resources(spark, sf, "a")), D.normalize_resources(resources(spark, sf, "b"))


AB = f"""pa AS (SELECT *, {PLURAL} AS kind, p_brand AS ns, p_name || '-' || p_partkey AS name FROM part),
       cmp AS (SELECT kind, ns, name, p_partkey AS i, p_size, p_retailprice, CASE WHEN p_partkey % 7 = 0 THEN 'ONLY_A' WHEN p_partkey % 5 = 0 OR p_partkey % 9 = 0 THEN 'DIFF' ELSE 'OK' END AS status FROM pa
       UNION ALL SELECT kind, ns, 'new ' || name, p_partkey, p_size, p_retailprice, 'ONLY_B' FROM pa WHERE p_partkey % 11 = 0)"""


@query("d_compare_states", f"WITH {AB} SELECT kind, ns, name, status FROM cmp")
def d_compare_states(spark, sf):
    return D.compare_states(*states(spark, sf)).select("kind", "ns", "name", "status")


@query("d_drift_counts", f"""WITH {AB} SELECT kind, sum((status = 'OK')::INT)::BIGINT AS ok, sum((status = 'DIFF')::INT)::BIGINT AS diff, sum((status = 'ONLY_A')::INT)::BIGINT AS only_a,
       sum((status = 'ONLY_B')::INT)::BIGINT AS only_b, count(*) AS total FROM cmp GROUP BY 1""")
def d_drift_counts(spark, sf):
    return D.drift_counts(D.compare_states(*states(spark, sf)))


@query("d_field_diff", f"""WITH {AB} SELECT kind, ns, name, 'spec.size' AS path, p_size::VARCHAR AS a, (p_size + 1)::VARCHAR AS b FROM cmp WHERE status = 'DIFF' AND i % 5 = 0
       UNION ALL SELECT kind, ns, name, 'spec.cost', '{{"price": ' || p_retailprice::VARCHAR || ', "tier": 1}}', NULL FROM cmp WHERE status = 'DIFF' AND i % 15 = 0""")
def d_field_diff(spark, sf):
    a, b = states(spark, sf)
    return D.field_diff(D.compare_states(a, b), a, b)


@query("d_flatten_doc", """WITH pa AS (SELECT *, p_name || '-' || p_partkey AS name FROM part)
       SELECT path, count(*) AS n FROM (SELECT unnest(['metadata.name', 'metadata.namespace', 'spec.size', 'spec.cost.price', 'spec.cost.tier',
       'spec.containers[0].name', 'spec.containers[0].image', 'spec.containers[1].name', 'spec.containers[1].image']) AS path FROM pa
       UNION ALL SELECT 'metadata.annotations.note' FROM pa WHERE p_partkey % 3 = 0 UNION ALL SELECT 'data.token' FROM pa WHERE p_partkey % 4 = 3
       UNION ALL SELECT 'data' FROM pa WHERE p_partkey % 4 = 2) GROUP BY 1""")
def d_flatten_doc(spark, sf):
    return D.flatten_doc(states(spark, sf)[0]).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("d_filter_drift", f"WITH {AB} SELECT kind, ns, name, status FROM cmp WHERE kind = 'secrets' AND ns = 'Brand#11' AND status <> 'OK'".replace("status <> 'OK'", "status = 'DIFF'"))
def d_filter_drift(spark, sf):
    return D.filter_drift(D.compare_states(*states(spark, sf)), "secrets", "Brand#11", "DIFF").select("kind", "ns", "name", "status")


@query("d_namespaces", "SELECT DISTINCT p_brand AS ns FROM part")
def d_namespaces(spark, sf):
    return D.namespaces(resources(spark, sf, "a"), resources(spark, sf, "b"))


@query("p_hide_secret_values", "SELECT p_partkey, 'sha256:' || substr(sha256(p_type), 1, 16) AS digest FROM part WHERE p_partkey % 4 = 3")
def p_hide_secret_values(spark, sf):
    v = D.secret_values(resources(spark, sf, "a"))
    return v.select(F.substring_index("name", "-", -1).cast("bigint").alias("p_partkey"), D.hide_secret_values(F.col("value")).alias("digest"))


@query("j_full_outer_compare", """WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS v FROM part WHERE p_partkey % 4 <> 0)
       SELECT k, a.v AS a, b.v AS b, CASE WHEN b.k IS NULL THEN 'ONLY_A' WHEN a.k IS NULL THEN 'ONLY_B' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'OK' ELSE 'DIFF' END AS status FROM a FULL JOIN b USING (k)""")
def j_full_outer_compare(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    b = p.where("k % 4 != 0").withColumn("v", F.when(F.col("k") % 5 != 0, F.col("v")))
    return D.full_outer_compare(p.where("k % 7 != 0"), b, ["k"], "v")


# ---- fleet ----

AT = T0 + 30 * 86400  # the end of the events
LAST_DAY = AT - 86400


def agents(spark, sf):
    """One agent per (user group, event type): its last sample."""
    d = events(spark, sf).withColumns({
        "node": F.concat(F.lit("n"), (F.col("user_id") % 40).cast("string")), "role": F.col("event_type")})
    return d.groupBy("node", "role").agg(F.max("ts").alias("last_ts"), F.max_by("k", "us").alias("k"), F.max_by("model", "us").alias("model")).withColumns(
        {"up": F.when(F.col("k") > 10, 1.0).otherwise(0.0), "healthy": F.when(F.col("k") > 25, 1.0).otherwise(0.0)})


AGENTS = EV + f""", ag AS (SELECT 'n' || (user_id % 40) AS node, event_type AS role, max(us) AS last, arg_max(k, us) AS k, arg_max(model, us) AS model FROM ev
       GROUP BY ALL), f AS (SELECT *, {AT}000000 - last < 36000000000 AS fresh FROM ag), s AS (SELECT *, CASE WHEN NOT fresh AND NOT bool_or(fresh) OVER (PARTITION BY node) THEN 'unknown'
       WHEN NOT fresh THEN 'down' WHEN k <= 10 THEN 'down' WHEN k <= 25 THEN 'degraded' ELSE 'up' END AS status FROM f)"""


def fleet(spark, sf):
    return FL.agent_status(agents(spark, sf), F.timestamp_seconds(F.lit(AT)), 36000)


@query("f_agent_status", f"WITH {AGENTS} SELECT node, role, status FROM s")
def f_agent_status(spark, sf):
    return fleet(spark, sf).select("node", "role", "status")


@query("f_status_kpis", f"""WITH {AGENTS} SELECT sum((status = 'up')::INT)::BIGINT AS up, sum((status = 'degraded')::INT)::BIGINT AS degraded, sum((status = 'unknown')::INT)::BIGINT AS unknown,
       sum((status = 'down')::INT)::BIGINT AS down, count(DISTINCT node) FILTER (status IN ('up', 'degraded')) AS nodes_online, count(DISTINCT model) FILTER (status IN ('up', 'degraded')) AS models,
       round(100.0 * sum((status = 'up')::INT) / count(*), 0)::DOUBLE AS percent_up, sum((status <> 'up')::INT)::BIGINT AS needs_action FROM s""")
def f_status_kpis(spark, sf):
    return FL.status_kpis(fleet(spark, sf))


@query("f_role_matrix", f"WITH {AGENTS} SELECT role, sum((status = 'up')::INT)::BIGINT AS up, count(*) AS expected FROM s GROUP BY 1")
def f_role_matrix(spark, sf):
    return FL.role_matrix(fleet(spark, sf))


NODES = [f"n{i}" for i in range(40)]


@query("f_role_pivot", f"WITH {AGENTS} SELECT role, " + ", ".join(f"max(status) FILTER (node = '{n}') AS {n}" for n in NODES) + " FROM s GROUP BY 1")
def f_role_pivot(spark, sf):
    return FL.role_pivot(fleet(spark, sf), NODES)


@query("o_worst_first", f"WITH {AGENTS} SELECT node, role, status FROM s ORDER BY list_position(['down', 'unknown', 'degraded', 'up'], status), node")
def o_worst_first(spark, sf):
    return ST.worst_first(fleet(spark, sf)).select("node", "role", "status")


def history(spark, sf):
    d = events(spark, sf)
    k = F.col("k")
    status = F.when(k < 10, "down").when(k < 20, "unknown").when(k < 35, "degraded").otherwise("up")
    return d.select("node", F.col("event_type").alias("role"), F.floor(F.col("us") / 1_000_000).cast("bigint").alias("t"), status.alias("status"))


HIST = EV + """, hs AS (SELECT node, event_type AS role, us // 1000000 AS t, CASE WHEN k < 10 THEN 'down' WHEN k < 20 THEN 'unknown' WHEN k < 35 THEN 'degraded' ELSE 'up' END AS status FROM ev),
       hm AS (SELECT node, (t // 3600) * 3600 AS t, ['up', 'degraded', 'unknown', 'down'][max(list_position(['up', 'degraded', 'unknown', 'down'], status))] AS status FROM hs GROUP BY ALL)"""


@query("f_status_heatmap", f"WITH {HIST} SELECT node, t, status FROM hm")
def f_status_heatmap(spark, sf):
    return FL.status_heatmap(history(spark, sf), 3600)


@query("f_minutes_impacted", f"WITH {HIST} SELECT node, sum((status <> 'up')::INT)::BIGINT AS impacted, arg_max(status, t) AS current FROM hm GROUP BY 1")
def f_minutes_impacted(spark, sf):
    return FL.minutes_impacted(FL.status_heatmap(history(spark, sf), 3600))


def daily(spark, sf):
    """Worst state per agent and day."""
    h = history(spark, sf)
    return h.groupBy("node", "role", (F.floor(F.col("t") / 86400) * 86400).cast("bigint").alias("t")).agg(
        F.max_by("status", FL.status_rank(F.col("status"))).alias("status"))


@query("f_open_problems", f"""WITH {HIST}, r AS (SELECT node, role, (t // 86400) * 86400 AS t, ['up', 'degraded', 'unknown', 'down'][max(list_position(['up', 'degraded', 'unknown', 'down'], status))] AS status FROM hs GROUP BY ALL),
       x AS (SELECT *, coalesce(max(CASE WHEN status = 'up' THEN t END) OVER (PARTITION BY node, role ORDER BY t) + 86400, min(t) OVER (PARTITION BY node, role)) AS since FROM r WHERE t <= {LAST_DAY})
       SELECT node, role, status, {LAST_DAY} - since AS outage_seconds FROM x WHERE t = {LAST_DAY} AND status <> 'up'""")
def f_open_problems(spark, sf):
    return FL.open_problems(daily(spark, sf), 86400, LAST_DAY)


@query("f_problem_kpis", f"""WITH {HIST}, r AS (SELECT node, role, (t // 86400) * 86400 AS t, ['up', 'degraded', 'unknown', 'down'][max(list_position(['up', 'degraded', 'unknown', 'down'], status))] AS status FROM hs GROUP BY ALL),
       x AS (SELECT *, coalesce(max(CASE WHEN status = 'up' THEN t END) OVER (PARTITION BY node, role ORDER BY t) + 86400, min(t) OVER (PARTITION BY node, role)) AS since FROM r),
       o AS (SELECT node, role, {LAST_DAY} - since AS s FROM x WHERE t = {LAST_DAY} AND status <> 'up'),
       e AS (SELECT node FROM ev WHERE event_type = 'error' AND us > {AT - 86400}000000 AND us <= {AT}000000)
       SELECT (SELECT count(*) FROM o) AS needs_action, (SELECT count(*) FROM e) AS restarts, (SELECT count(DISTINCT node) FROM e) AS nodes_restarted, max(s) AS oldest_outage_seconds,
       (SELECT node FROM o ORDER BY s DESC, node, role LIMIT 1) AS oldest_node, (SELECT role FROM o ORDER BY s DESC, node, role LIMIT 1) AS oldest_role FROM o""")
def f_problem_kpis(spark, sf):
    restarts = events(spark, sf).where("event_type = 'error'").select("node", "ts")
    return FL.problem_kpis(FL.open_problems(daily(spark, sf), 86400, LAST_DAY), restarts, AT, 86400)


@query("d_snapshot_state", f"WITH {AB} SELECT kind, ns, name, status FROM cmp")
def d_snapshot_state(spark, sf):
    """Two states kept in one snapshot table and compared by the time they were saved at."""
    folder = fresh_folder(spark, "snapshots")
    for state, at in zip(states(spark, sf), ("2024-01-01 00:00:00", "2024-01-02 00:00:00"), strict=True):
        D.snapshot_state(state, at).write.mode("append").partitionBy("saved_at").parquet(folder)
    table_ = spark.read.parquet(folder)
    a, b = (table_.where(F.col("saved_at") == F.to_timestamp(F.lit(at))) for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"))
    return D.compare_states(a, b).select("kind", "ns", "name", "status")


@query("s_read_resources", f"""SELECT {PLURAL} AS kind, p_brand AS ns, p_name || '-' || p_partkey AS name, p_size::BIGINT AS size FROM part
       UNION ALL SELECT {PLURAL}, p_brand, p_name || '-' || p_partkey, p_size + 1 FROM part WHERE p_partkey % 4 > 1""")
def s_read_resources(spark, sf):
    """Dumps of both forms, read from files: a list of items per brand, and one snapshot of configs and secrets per brand."""
    folder = fresh_folder(spark, "dumps")
    p = table(spark, sf, "part")
    name = F.concat_ws("-", "p_name", F.col("p_partkey").cast("string"))

    def doc(size):
        return F.to_json(F.struct(F.expr(KINDS).alias("kind"), F.struct(name.alias("name"), F.col("p_brand").alias("namespace")).alias("metadata"), F.struct(size.alias("size")).alias("spec")))

    items = p.groupBy("p_brand").agg(F.concat(F.lit('{"kind": "List", "items": ['), F.array_join(F.collect_list(doc(F.col("p_size"))), ", "), F.lit("]}")).alias("value"))
    entry = F.concat(F.lit('"'), F.concat_ws("/", "p_brand", name), F.lit('": '), doc(F.col("p_size") + 1))
    kept = p.where("p_partkey % 4 > 1").select("p_brand", F.expr(PLURAL).alias("kind"), entry.alias("e"))
    per = kept.groupBy("p_brand", "kind").agg(F.array_join(F.collect_list("e"), ", ").alias("v"))
    saved_ = per.groupBy("p_brand").agg(F.concat(F.lit('{"saved_at": "x", "state": {'), F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("kind"), F.lit('": {'), F.col("v"), F.lit("}"))), ", "), F.lit("}}")).alias("value"))
    items.unionByName(saved_).select("value").repartition(8, "value").write.text(f"{folder}/all", lineSep="\n")
    got = RD.read_resources(spark, f"{folder}/all", "x", per_line=True)
    kind = F.when(F.lower("kind").isin(*D.KINDS.values()), F.lower("kind")).otherwise(F.create_map(*[F.lit(x) for kv in D.KINDS.items() for x in kv])[F.lower("kind")])
    return got.select(kind.alias("kind"), "ns", "name", F.get_json_object("doc", "$.spec.size").cast("bigint").alias("size"))

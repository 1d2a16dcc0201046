"""Vector algebra over labelled samples."""

from pyspark.sql import functions as F

from servelens.naming import BOUNDS
from servelens.operators import histograms as H
from servelens.operators import samples as S
from servelens.operators import vector as V

from .adapters import (
    CTR, EV, GEN_BOUNDS, HOURLY, SIXHOURLY, T0, bucket_increments, bucket_samples, call_counter, call_increments,
    counter, events, grid_cte, out, quantile_sql, samples, table, window_sum)
from .registry import query

H_GRID, S_GRID = grid_cte(HOURLY), grid_cte(SIXHOURLY)


def ctr_roll(spark, sf, res=3600):
    d = counter(spark, sf).select("event_type", "user", "ts", "event_id", "value")
    return S.counter_increments(d, res, ["event_type", "user"], tie="event_id")


def gauges(spark, sf, res=3600):
    d = events(spark, sf).select("event_type", "model", "ts", "event_id", "value")
    return S.gauge_rollup(d, res, ["event_type", "model"], tie="event_id")


def means(spark, sf, res=3600):
    return S.value_rollup(events(spark, sf).select("event_type", "model", "ts", "value"), res)


def req_roll(spark, sf, labels, res=3600, **kw):
    return S.counter_increments(call_counter(spark, sf, labels, **kw), res, labels)


R6 = "round({}, 6) AS value"


@query("t_increase_by_type", f"WITH {CTR}, {H_GRID} SELECT t, event_type, round(value, 6) AS value FROM ("
       + window_sum("inc", 21600, ["event_type"]) + ")")
def t_increase_by_type(spark, sf):
    return out(S.increase(ctr_roll(spark, sf), 21600, HOURLY, ["event_type"]))


@query("t_increase_series", f"""WITH {CTR}, {S_GRID} SELECT t, event_type, "user", round(value, 6) AS value FROM (
       SELECT g.t AS t, i.event_type, i."user", sum(i.inc) AS value FROM grid g JOIN inc i
       ON i.us > (g.t - 86400) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL)""")
def t_increase_series(spark, sf):
    return out(S.increase(ctr_roll(spark, sf, 21600), 86400, SIXHOURLY))


@query("t_rate_by_model", f"WITH {EV}, {H_GRID}, {call_increments('req', ['model', 'kind'])} SELECT t, model, kind, "
       "round(value / 3600.0, 9) AS value FROM (" + window_sum("req", 3600, ["model", "kind"]) + ")")
def t_rate_by_model(spark, sf):
    return out(S.rate(req_roll(spark, sf, ["model", "kind"]), 3600, HOURLY, ["model", "kind"]), 9)


@query("t_instant", f"""WITH {EV}, {H_GRID} SELECT t, event_type, model, round(value, 6) AS value FROM (
       SELECT g.t AS t, i.event_type, i.model, arg_max(i.value, i.us) AS value FROM grid g JOIN ev i
       ON i.us > (g.t - 7200) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL)""")
def t_instant(spark, sf):
    return out(S.instant(gauges(spark, sf), HOURLY, 7200))


@query("t_avg_over_time", f"WITH {EV}, {H_GRID} SELECT t, event_type, model, round(value, 6) AS value FROM ("
       + window_sum("ev", 10800, ["event_type", "model"], "avg(i.value)") + ")")
def t_avg_over_time(spark, sf):
    return out(S.avg_over_time(means(spark, sf), 10800, HOURLY))


@query("t_offset_delta", f"""WITH {EV}, {H_GRID}, a AS ({window_sum('ev', 7200, ['model'], 'avg(i.value)')}),
       b AS ({window_sum('ev', 7200, ['model'], 'avg(i.value)', shift=7200)})
       SELECT a.t, a.model, round(a.value - b.value, 6) AS value FROM a JOIN b USING (t, model)""")
def t_offset_delta(spark, sf):
    roll = means(spark, sf)
    now = S.avg_over_time(roll, 7200, HOURLY, ["model"])
    before = V.offset(S.avg_over_time(roll, 7200, V.shifted(HOURLY, 7200), ["model"]), 7200)
    return out(V.arith(now, "-", before))


@query("t_absent", f"""WITH {EV}, {grid_cte(S.Grid(T0, T0 + 30 * 86400, 60))}
       SELECT g.t AS t, 1.0::DOUBLE AS value FROM grid g LEFT JOIN
       (SELECT DISTINCT -((-us) // 60000000) * 60 AS b FROM ev WHERE model = 'm1' AND event_type = 'error') e
       ON e.b > g.t - 14400 AND e.b <= g.t WHERE e.b IS NULL""".replace(
           "-((-us) // 60000000) * 60", "((us + 59999999) // 60000000) * 60"))
def t_absent(spark, sf):
    d = events(spark, sf).where((F.col("model") == "m1") & (F.col("event_type") == "error"))
    return S.absent_over_time(d, 14400, S.Grid(T0, T0 + 30 * 86400, 60))


@query("t_histogram_quantile", f"""WITH {EV}, {S_GRID}, {bucket_increments('bk', 'gen', GEN_BOUNDS, ['model'])},
       v AS ({window_sum('bk', 86400, ['model', 'le', 'bound'])})
       SELECT t, model, round(value, 6) AS value FROM ({quantile_sql(0.95, 'v', ['model'])})""")
def t_histogram_quantile(spark, sf):
    b = bucket_samples(spark, sf, "gen", GEN_BOUNDS, ["model"])
    inc = S.counter_increments(b, 21600, ["model", "le"])
    return out(H.histogram_quantile(0.95, S.increase(inc, 86400, SIXHOURLY, ["model", "le"])))


@query("t_bucket_fraction", f"""WITH {EV}, {S_GRID}, {bucket_increments('bk', 'gen', GEN_BOUNDS, ['model'])},
       v AS ({window_sum('bk', 86400, ['model', 'le'])})
       SELECT a.t, a.model, round(a.value / greatest(b.value, 1), 6) AS value FROM v a JOIN v b USING (t, model)
       WHERE a.le = '10' AND b.le = '+Inf'""")
def t_bucket_fraction(spark, sf):
    b = bucket_samples(spark, sf, "gen", GEN_BOUNDS, ["model"])
    v = S.increase(S.counter_increments(b, 21600, ["model", "le"]), 86400, SIXHOURLY, ["model", "le"])
    one = v.where("le = '10'").drop("le")
    return out(H.bucket_fraction(one, v.where("le = '+Inf'").drop("le"), 1.0))


@query("t_error_ratio", f"""WITH {EV}, {H_GRID}, {call_increments('req', ['model'])},
       {call_increments('err', ['model'], where='status >= 400')},
       r AS ({window_sum('req', 21600, ['model'])}), e AS ({window_sum('err', 21600, ['model'])})
       SELECT t, model, round(100 * (e.value / 21600.0) / greatest(r.value / 21600.0, 0.0001), 6) AS value
       FROM e JOIN r USING (t, model)""")
def t_error_ratio(spark, sf):
    err = S.rate(req_roll(spark, sf, ["model"], where=F.col("status") >= 400), 21600, HOURLY, ["model"])
    req = S.rate(req_roll(spark, sf, ["model"]), 21600, HOURLY, ["model"])
    return out(V.scalar(V.arith(err, "/", V.clamp_min(req, 0.0001)), "*", 100))


@query("t_agg_min_max", f"""WITH {EV}, {H_GRID}, v AS (
       SELECT g.t AS t, i.event_type, i.model, arg_max(i.value, i.us) AS value FROM grid g JOIN ev i
       ON i.us > (g.t - 7200) * 1000000 AND i.us <= g.t * 1000000 GROUP BY ALL)
       SELECT t, event_type, round(min(value), 6) AS lo, round(max(value), 6) AS hi, count(*)::DOUBLE AS n
       FROM v GROUP BY ALL""")
def t_agg_min_max(spark, sf):
    v = S.instant(gauges(spark, sf), HOURLY, 7200)
    lo, hi = V.agg_by(v, "min", ["event_type"]), V.agg_by(v, "max", ["event_type"])
    n = V.count_by(v, ["event_type"])
    key = ["t", "event_type"]
    return out(lo.withColumnRenamed("value", "lo").join(hi.withColumnRenamed("value", "hi"), key)
               .join(n.withColumnRenamed("value", "n"), key))


@query("t_distinct_active", f"""WITH {CTR}, {S_GRID}, v AS (
       SELECT g.t AS t, i."user" FROM grid g JOIN inc i ON i.us > (g.t - 86400) * 1000000 AND i.us <= g.t * 1000000
       WHERE i.event_type = 'purchase' GROUP BY ALL) SELECT t, count(*)::DOUBLE AS value FROM v GROUP BY t""")
def t_distinct_active(spark, sf):
    roll = ctr_roll(spark, sf, 21600).where("event_type = 'purchase'")
    return V.count_by(S.increase(roll, 86400, SIXHOURLY, ["user"]))


@query("t_compare_filter", f"""WITH {EV}, {H_GRID}, v AS ({window_sum('ev', 10800, ['event_type', 'model'], 'avg(i.value)')})
       SELECT t, event_type, model, round(value, 6) AS value FROM v WHERE value > 60""")
def t_compare_filter(spark, sf):
    return out(V.cmp(S.avg_over_time(means(spark, sf), 10800, HOURLY), ">", 60))


@query("t_compare_vectors", f"""WITH {EV}, {H_GRID}, v AS ({window_sum('ev', 10800, ['event_type', 'model'], 'avg(i.value)')})
       SELECT a.t, a.model, round(a.value, 6) AS value FROM v a JOIN v b USING (t, model)
       WHERE a.event_type = 'error' AND b.event_type = 'view' AND a.value > b.value""")
def t_compare_vectors(spark, sf):
    v = S.avg_over_time(means(spark, sf), 10800, HOURLY)
    return out(V.cmp(v.where("event_type = 'error'").drop("event_type"), ">",
                     v.where("event_type = 'view'").drop("event_type")))


@query("t_and", f"""WITH {EV}, {H_GRID}, v AS ({window_sum('ev', 10800, ['event_type', 'model'], 'avg(i.value)')})
       SELECT t, event_type, model, round(value, 6) AS value FROM v a WHERE value > 40 AND EXISTS (
       SELECT 1 FROM v b WHERE b.t = a.t AND b.model = a.model AND b.event_type = 'signup' AND b.value > 50)""")
def t_and(spark, sf):
    v = S.avg_over_time(means(spark, sf), 10800, HOURLY)
    return out(V.vec_and(V.cmp(v, ">", 40), V.cmp(v.where("event_type = 'signup'"), ">", 50), on=["model"]))


@query("t_or_constant", f"""WITH {EV}, {H_GRID}, v AS ({window_sum('ev', 3600, ['event_type'], 'avg(i.value)')})
       SELECT g.t AS t, round(coalesce(v.value, 100.0), 6) AS value FROM grid g LEFT JOIN v ON v.t = g.t
       AND v.event_type = 'error'""")
def t_or_constant(spark, sf):
    v = S.avg_over_time(means(spark, sf), 3600, HOURLY, ["event_type"]).where("event_type = 'error'").drop("event_type")
    return out(V.vec_or(v, V.constant(spark, HOURLY, 100.0), on=[]))


@query("t_info_join", f"""WITH {EV}, {H_GRID}, v AS ({window_sum('ev', 3600, ['node'], 'avg(i.value)')}),
       info AS (SELECT 'n' || n_nationkey::VARCHAR AS node, n_name AS path FROM nation)
       SELECT t, node, path, round(value, 6) AS value FROM v JOIN info USING (node)""")
def t_info_join(spark, sf):
    d = events(spark, sf).select("node", "ts", "event_id", "value")
    v = S.avg_over_time(S.value_rollup(d, 3600, ["node"]), 3600, HOURLY)
    info = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("path"))
    return out(V.info_join(v, info, ["node"], ["path"]))


@query("t_last_not_null", f"""WITH {EV}, {H_GRID}, v AS ({window_sum('ev', 3600, ['event_type', 'model'], 'avg(i.value)')})
       SELECT event_type, model, max(t) AS t, round(arg_max(value, t), 6) AS value FROM v GROUP BY ALL""")
def t_last_not_null(spark, sf):
    return out(V.last_not_null(S.avg_over_time(means(spark, sf), 3600, HOURLY)))


@query("t_value_heatmap", f"""WITH {EV}, lim AS (SELECT min(value) AS lo, max(value) AS hi FROM ev)
       SELECT (us // 21600000000) * 21600 AS t, node, b AS bin, round(lo + b * (hi - lo) / 24.0, 6) AS lower, count(*) AS n
       FROM (SELECT us, node, lo, hi, CAST(least(floor((value - lo) / ((hi - lo) / 24.0)), 23) AS INTEGER) AS b FROM ev, lim)
       GROUP BY ALL""")
def t_value_heatmap(spark, sf):
    return out(V.value_heatmap(events(spark, sf), 21600, 24, ["node"]))


@query("t_share_of_total", f"""WITH {CTR}, {S_GRID}, v AS ({window_sum('inc', 86400, ['event_type'])})
       SELECT t, event_type, round(100.0 * value / greatest(sum(value) OVER (PARTITION BY t), 1), 6) AS value FROM v""")
def t_share_of_total(spark, sf):
    return out(V.share_of_total(S.increase(ctr_roll(spark, sf, 21600), 86400, SIXHOURLY, ["event_type"])))


@query("t_total_across_resets", f"""WITH {CTR}, b AS (
       SELECT event_type, "user", ((us + 86399999999) // 86400000000) * 86400 AS t, sum(inc) AS inc FROM inc GROUP BY ALL)
       SELECT t, event_type, "user", round(sum(inc) OVER (PARTITION BY event_type, "user" ORDER BY t), 6) AS value FROM b""")
def t_total_across_resets(spark, sf):
    return out(S.total_across_resets(ctr_roll(spark, sf, 86400)))


@query("t_grid", f"WITH {H_GRID} SELECT g.t AS t, count(e.ts) AS n FROM grid g LEFT JOIN events e "
       "ON epoch_us(e.ts) > (g.t - 3600) * 1000000 AND epoch_us(e.ts) <= g.t * 1000000 GROUP BY g.t")
def t_grid(spark, sf):
    per = events(spark, sf).groupBy(S.bucket_end("ts", 3600).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return HOURLY.frame(spark).join(per, "t", "left").na.fill(0, ["n"])


@query("p_select_series", """SELECT event_type AS metric, count(*) AS n, round(sum(value), 2) AS total FROM events
       WHERE event_type = 'click' AND ('m' || (user_id % 3)::VARCHAR) = 'm1'
       AND regexp_full_match(user_id::VARCHAR, '1.*') GROUP BY 1""")
def p_select_series(spark, sf):
    d = S.select_series(samples(spark, sf), "click", ["model"], eq={"model": "m1"}, re={"user": "1.*"})
    return d.groupBy(F.lit("click").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("p_bind_variables", """SELECT event_type, count(*) AS n FROM events
       WHERE 'm' || (user_id % 3)::VARCHAR IN ('m0', 'm2') GROUP BY 1""")
def p_bind_variables(spark, sf):
    v = S.bind_variables({"model": ["m0", "m2"], "user": "All"})
    return samples(spark, sf).where(S.matcher(F.col("labels"), re=v)).groupBy(
        F.col("metric").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("p_label_values", "SELECT DISTINCT user_id::VARCHAR AS \"user\" FROM events WHERE event_type = 'view'")
def p_label_values(spark, sf):
    return S.label_values(samples(spark, sf), "view", "user")


@query("p_dedup_sources", """SELECT event_type AS metric, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def p_dedup_sources(spark, sf):
    s = samples(spark, sf)
    other = s.withColumn("labels", F.map_concat(F.map_filter("labels", lambda k, _: k != "job"),
                                                F.create_map(F.lit("job"), F.lit("otlp"))))
    one = S.dedup_sources(s.unionByName(other.withColumn("value", F.col("value") + 1)), ["j0", "j1"])
    return one.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


TARGETS_SQL = """tgt AS (SELECT 'j' || (n_nationkey % 2)::VARCHAR AS job, 'n' || n_nationkey::VARCHAR AS instance,
       n_name AS service FROM nation WHERE n_nationkey < 6)"""


def targets(spark, sf):
    return table(spark, sf, "nation").where("n_nationkey < 6").select(
        F.concat(F.lit("j"), (F.col("n_nationkey") % 2).cast("string")).alias("job"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("instance"), F.col("n_name").alias("service"))


@query("s_merge_target_labels", f"""WITH {EV}, {TARGETS_SQL} SELECT coalesce(t.service, '') AS service, count(*) AS n
       FROM ev e LEFT JOIN tgt t ON t.job = 'j' || (e.k % 2)::VARCHAR AND t.instance = e.node GROUP BY 1""")
def s_merge_target_labels(spark, sf):
    tgt = targets(spark, sf).select("job", "instance", F.create_map(F.lit("service"), F.col("service")).alias("labels"))
    d = S.merge_target_labels(samples(spark, sf), tgt)
    return d.groupBy(F.coalesce(F.col("labels")["service"], F.lit("")).alias("service")).agg(F.count(F.lit(1)).alias("n"))


@query("s_synthesize_up", f"""WITH {EV}, {TARGETS_SQL}, {H_GRID}, seen AS (
       SELECT 'j' || (k % 2)::VARCHAR AS job, node AS instance, us FROM ev)
       SELECT g.t AS t, tgt.job, tgt.instance, tgt.service, CASE WHEN count(s.us) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value
       FROM grid g CROSS JOIN tgt LEFT JOIN seen s ON s.job = tgt.job AND s.instance = tgt.instance
       AND s.us > (g.t - 3600) * 1000000 AND s.us <= g.t * 1000000 GROUP BY ALL""")
def s_synthesize_up(spark, sf):
    return S.synthesize_up(samples(spark, sf), targets(spark, sf), HOURLY, 3600)


@query("u_series_set_diff", f"""WITH {EV}, a AS (SELECT DISTINCT event_type AS metric, user_id FROM ev WHERE k < 50),
       b AS (SELECT DISTINCT event_type AS metric, user_id FROM ev WHERE k >= 50)
       SELECT side, metric, count(*) AS n FROM (
         SELECT 'only_a' AS side, metric FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
         UNION ALL SELECT 'only_b', metric FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY ALL""")
def u_series_set_diff(spark, sf):
    d = events(spark, sf)

    def store(rows):
        return rows.select(F.col("event_type").alias("metric"),
                           F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"))

    return V.series_set_diff(store(d.where("k < 50")), store(d.where("k >= 50"))).groupBy("side", "metric").agg(
        F.count(F.lit(1)).alias("n"))


@query("o_sort_desc", f"""WITH {CTR}, v AS (SELECT event_type, "user", sum(inc) AS value FROM inc GROUP BY ALL)
       SELECT event_type, "user", round(value, 6) AS value FROM v ORDER BY value DESC""")
def o_sort_desc(spark, sf):
    end = S.Grid(HOURLY.end, HOURLY.end, 86400)
    return out(V.sort_desc(S.increase(ctr_roll(spark, sf, 86400), 40 * 86400, end).drop("t")))


@query("a_to_histogram", f"""WITH {EV}, b AS (SELECT unnest({list(map(float, BOUNDS['ttft_seconds']))} || ['inf'::DOUBLE]) AS bound)
       SELECT model, CASE WHEN isinf(bound) THEN '+Inf' WHEN bound = floor(bound) THEN bound::BIGINT::VARCHAR
       ELSE bound::VARCHAR END AS le, sum(CASE WHEN ttft <= bound THEN 1 ELSE 0 END)::DOUBLE AS value
       FROM ev CROSS JOIN b GROUP BY ALL""")
def a_to_histogram(spark, sf):
    return H.to_histogram(events(spark, sf), "ttft", BOUNDS["ttft_seconds"], ["model"])


@query("a_histogram_summary", f"""WITH {EV} SELECT model, kind, round(sum(ttft), 4) AS total, count(*) AS observations
       FROM ev GROUP BY ALL""")
def a_histogram_summary(spark, sf):
    return out(H.histogram_summary(events(spark, sf), "ttft", ["model", "kind"]), 4)

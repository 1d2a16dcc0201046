"""Text sources, sinks and streaming twins.  Streams drain files written to a scratch folder."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from servelens.operators import logs as G
from servelens.operators import requests as R
from servelens.operators import samples as S
from servelens.operators import stats as ST
from servelens.scratch import fresh_folder, saved
from servelens.sources import readers as RD
from servelens.sources import writers as WR
from servelens.streaming import streams as W

from . import alerting as AL
from .adapters import CTR, EV, counter, events, table
from .calls import chunks, r_request_facts, request_rows
from .logs import CLASSIFIED, lines
from .registry import ORACLES, query
from .scoring import JUDGED, TRACES, TRIM, traces


def scratch(spark) -> str:
    """A fresh folder below the one that driver and executors share."""
    return fresh_folder(spark, "flows")


def staged(spark, df, folder):
    """Write a batch frame as files and open them as a stream."""
    df.write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def drained(spark, stream, folder, windows=()):
    """Run a streaming frame over everything there is and read its result back.

    Of ``windows``, columns that name a window, each micro-batch tells those it changed and the last word on each counts;
    so the windows that are still open when the stream ends are told as well.
    """
    def write(batch, epoch):
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{folder}/out")

    (stream.writeStream.outputMode("update" if windows else "append").foreachBatch(write).option("checkpointLocation", f"{folder}/ck")
     .trigger(availableNow=True).start().awaitTermination())
    told = spark.read.parquet(f"{folder}/out")
    if not windows:
        return told.drop("_epoch")
    rest = [c for c in told.columns if c not in (*windows, "_epoch")]
    return told.groupBy(*windows).agg(F.max_by(F.struct(*rest), "_epoch").alias("_last")).select(*windows, "_last.*")


def exposition(spark, sf):
    d = events(spark, sf)
    line = F.when(F.col("k") % 10 == 0, "# HELP calls help").when(F.col("k") % 10 == 1, F.concat(F.lit("up "), F.col("cents").cast("string"))).otherwise(
        F.concat(F.lit('calls_total{model="'), F.col("model"), F.lit('",path="a\\\\b \\"q\\"",le="+Inf"} '), F.when(F.col("k") % 10 == 2, "NaN").otherwise(F.col("cents").cast("string"))))
    return d.select("ts", line.alias("value"))


@query("s_read_exposition", f"""WITH {EV} SELECT CASE WHEN k % 10 = 1 THEN 'up' ELSE 'calls_total' END AS metric, CASE WHEN k % 10 = 1 THEN '' ELSE model END AS model,
       CASE WHEN k % 10 = 1 THEN '' ELSE 'a\\b "q"' END AS path, count(*) AS n, sum(CASE WHEN k % 10 = 2 THEN 0 ELSE cents END)::DOUBLE AS total FROM ev WHERE k % 10 <> 0 GROUP BY ALL""")
def s_read_exposition(spark, sf):
    d = RD.parse_exposition(exposition(spark, sf), F.col("ts"))
    lab = F.col("labels")
    return d.groupBy("metric", F.coalesce(lab["model"], F.lit("")).alias("model"), F.coalesce(lab["path"], F.lit("")).alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.nanvl("value", F.lit(0.0))).alias("total"))


def log_files(spark, sf, squeeze=1, whole=False):
    """Lines as files, a folder per source, each line behind its time in microseconds; read back with their positions."""
    folder = scratch(spark)
    d = lines(spark, sf).withColumn("at", F.floor(F.col("us") / squeeze).cast("bigint"))
    text = F.when(F.col("line") == "", "").otherwise(F.concat_ws(" ", F.col("at").cast("string"), "line"))
    (d.select("source", "seq", text.alias("value")).repartition("source").sortWithinPartitions("source", "seq").select("source", "value")
     .write.partitionBy("source").text(f"{folder}/logs"))
    got = RD.read_log_lines(spark, f"{folder}/logs", ts=F.timestamp_micros(F.substring_index("line", " ", 1).cast("bigint")))
    got = got.withColumn("source", F.regexp_extract("source", "source=([^/]+)", 1))
    return got if whole else got.withColumn("line", F.expr("substring(line, instr(line, ' ') + 1)"))


FILED = CLASSIFIED + """, fl AS (SELECT *, CAST(sum(n + 1) OVER (PARTITION BY source ORDER BY seq) - n - 1 AS BIGINT) AS at_byte FROM (
       SELECT source, seq, us, k, event_type, line, CASE WHEN line = '' THEN 0 ELSE length(line) + length(us::VARCHAR) + 1 END AS n FROM ln))"""


@query("s_read_log_lines", f"WITH {FILED} SELECT source, at_byte AS byte_offset, us, line FROM fl WHERE line <> ''")
def s_read_log_lines(spark, sf):
    return log_files(spark, sf).select("source", "byte_offset", F.unix_micros("ts").alias("us"), "line")


@query("s_files_line_counts", CLASSIFIED.join(["WITH ", " SELECT (us // 86400000000) * 86400 AS t, split_part(c, '/', 1) AS severity, split_part(c, '/', 2) AS category, count(*) AS n FROM cl GROUP BY ALL"]))
def s_files_line_counts(spark, sf):
    """From files to counts: positions and times read, lines classified."""
    return G.line_counts(G.classify_lines(G.clean_lines(log_files(spark, sf))), 86400)


@query("s_files_rate_limit", ORACLES["g_rate_limit"])
def s_files_rate_limit(spark, sf):
    return G.rate_limit(log_files(spark, sf, 20000), 20.0, 60).groupBy("source", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("s_files_crash_reason", f"""WITH {FILED}, fu AS (SELECT *, us || ' ' || line AS whole FROM fl WHERE line <> ''),
       tl AS (SELECT e.source, e.seq AS exit_id, min(CASE WHEN regexp_matches(x, '\\[METAL\\].*(Command buffer execution failed|GPU errors)', 'i') THEN 0
         WHEN regexp_matches(x, '\\b(out of memory|OOM|allocation failed)\\b', 'i') THEN 2
         WHEN regexp_matches(x, '\\b(traceback|killed|segmentation fault|SIGABRT)\\b', 'i') THEN 3 ELSE 9 END) AS p
       FROM fu e LEFT JOIN LATERAL (SELECT substr(whole, CAST(greatest(e.at_byte - 200 - at_byte, 0) + 1 AS BIGINT)) AS x FROM fu l
         WHERE l.source = e.source AND l.at_byte < e.at_byte AND l.at_byte + length(l.whole) > e.at_byte - 200) l ON TRUE WHERE e.event_type = 'error' GROUP BY ALL)
       SELECT source, exit_id, CASE p WHEN 0 THEN 'metal_gpu_error' WHEN 2 THEN 'oom' WHEN 3 THEN 'python_error' ELSE 'exit' END AS reason FROM tl""")
def s_files_crash_reason(spark, sf):
    """From files to reasons: every logged error is an exit, its reason sought in the 200 bytes of the file before its line."""
    got = log_files(spark, sf, whole=True)
    exits = lines(spark, sf).where("event_type = 'error' and line <> ''").select("source", F.col("seq").alias("exit_id"), "us")
    exits = exits.join(got.select("source", F.unix_micros("ts").alias("us"), "byte_offset"), ["source", "us"])
    return G.crash_reason(exits, got.select("source", "byte_offset", "line"), 200).select("source", "exit_id", "reason")


@query("s_last_lines", f"WITH {EV} SELECT node AS source, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY event_id DESC) AS r FROM ev WHERE k % 12 <> 10) WHERE r <= 25")
def s_last_lines(spark, sf):
    return RD.last_lines(lines(spark, sf).where("line <> ''"), 25).select("source", "seq")


@query("s_read_otlp_logs", f"""WITH {CLASSIFIED} SELECT split_part(c, '/', 1) AS severity, split_part(c, '/', 2) AS category, count(*) AS n, sum(us)::BIGINT AS us FROM cl GROUP BY ALL""")
def s_read_otlp_logs(spark, sf):
    d = G.classify_lines(G.clean_lines(lines(spark, sf)))

    def attr(k, v):
        return F.struct(F.lit(f"mlx.log.{k}").alias("key"), F.struct(v.alias("stringValue")).alias("value"))

    rec = F.struct((F.col("us") * 1000).cast("string").alias("timeUnixNano"), F.col("severity").alias("severityText"), F.struct(F.col("line").alias("stringValue")).alias("body"),
                   F.array(attr("category", F.col("category")), attr("source", F.col("source"))).alias("attributes"))
    doc = d.select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(rec).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))).alias("j"))
    o = RD.parse_otlp(doc.select(F.from_json("j", RD.OTLP_SCHEMA).alias("x")).select("x.*"))
    exact = F.sum(F.unix_micros("ts").cast("decimal(20,0)")).cast("decimal(38,0)")
    return narrowed(saved(o.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"), exact.alias("us")), "otlp-totals"), "us")


def narrowed(totals, column):
    """Exact totals as BIGINT where all of them fit one, else as they are: five thousand times in microseconds add up to more."""
    beyond = totals.where(~F.col(column).between(-(1 << 63), (1 << 63) - 1)).limit(1).count()
    return totals if beyond else totals.withColumn(column, F.col(column).cast("bigint"))


@query("s_write_samples", """SELECT event_type AS metric, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-02-11' GROUP BY 1""")
def s_write_samples(spark, sf):
    from .adapters import samples
    folder = scratch(spark)
    WR.write_samples(samples(spark, sf), f"{folder}/samples")
    d = WR.read_samples(spark, f"{folder}/samples", "2024-02-10")
    return d.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s_write_log_jsonl", CLASSIFIED.join(["WITH ", " SELECT split_part(c, '/', 2) AS category, count(*) AS n, sum(length(line))::BIGINT AS chars FROM cl GROUP BY 1"]))
def s_write_log_jsonl(spark, sf):
    folder = scratch(spark)
    WR.write_log_jsonl(G.classify_lines(G.clean_lines(lines(spark, sf))).select("source", "seq", "ts", "line", "severity", "category"), f"{folder}/log")
    d = spark.read.schema("category string, line string").json(f"{folder}/log")
    return d.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


# ---- streams ----

@query("w_line_counts", CLASSIFIED.join(["WITH ", " SELECT (us // 3600000000) * 3600 AS t, split_part(c, '/', 1) AS severity, split_part(c, '/', 2) AS category, count(*) AS n FROM cl GROUP BY ALL"]))
def w_line_counts(spark, sf):
    folder = scratch(spark)
    s = W.line_counts(staged(spark, lines(spark, sf).select("source", "ts", "line"), folder), "1 hour")
    return drained(spark, s, folder, ["start", "severity", "category"]).select(F.unix_seconds("start").alias("t"), "severity", "category", "n")


@query("w_counter_increments", f"""WITH {CTR} SELECT event_type, "user", round(sum(inc), 6) AS total, count(*) AS n FROM inc GROUP BY ALL""")
def w_counter_increments(spark, sf):
    folder = scratch(spark)
    d = counter(spark, sf).select("event_type", "user", "ts", "value")
    s = W.counter_increments(staged(spark, d, folder), ["event_type", "user"])
    return drained(spark, s, folder).groupBy("event_type", "user").agg(F.round(F.sum("inc"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("w_sliding_sums", f"""WITH {CTR}, w AS (SELECT event_type, inc, us, unnest(range((us // 1800000000) * 1800 + 1800, (us // 1800000000) * 1800 + 7200 + 1, 1800)) AS t FROM inc)
       SELECT t, event_type, round(sum(inc), 6) AS value FROM w WHERE us >= (t - 7200) * 1000000 AND us < t * 1000000 GROUP BY ALL""")
def w_sliding_sums(spark, sf):
    folder = scratch(spark)
    prev = F.lag("value").over(Window.partitionBy("event_type", "user").orderBy("us", "event_id"))
    d = counter(spark, sf).withColumn("inc", S.step_increment(F.col("value"), prev)).select("event_type", "ts", "inc")
    s = W.sliding_sums(staged(spark, d, folder), ["event_type"], "2 hours", "30 minutes")
    return drained(spark, s, folder, ["t", "event_type"]).select(F.unix_seconds("t").alias("t"), "event_type", F.round("value", 6).alias("value"))


@query("w_alert_states", ORACLES["alert_high_error_rate"])
def w_alert_states(spark, sf):
    folder = scratch(spark)
    from servelens.operators import vector as V
    src = AL.source(spark, sf)
    cond = V.cmp(src.rate("error_total", 300, ["model", "status"]), ">", 0.2)
    s = W.alert_states(staged(spark, cond, folder), ["model", "status"], 300, AL.STEP)
    return drained(spark, s, folder).withColumn("value", F.round("value", 6))


@query("w_rate_limited", ORACLES["g_rate_limit"].replace("WHERE line <> ''", "").replace("FROM cl)", "FROM cl)"))
def w_rate_limited(spark, sf):
    folder = scratch(spark)
    d = lines(spark, sf).withColumn("ts", F.timestamp_micros(F.floor(F.col("us") / 20000).cast("bigint"))).select("source", "seq", "ts", "line")
    s = W.rate_limited(staged(spark, d, folder), 20.0)
    return drained(spark, s, folder).groupBy("source", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("w_assemble_streams", ORACLES["r_assemble_stream"])
def w_assemble_streams(spark, sf):
    folder = scratch(spark)
    s = W.assemble_streams(staged(spark, chunks(spark, sf), folder))
    d = R.stream_completion_tokens(W.streamed_requests(drained(spark, s, folder)))
    return d.select("request_id", "content", "completion_tokens", "finish_reason",
                    F.array_join(F.transform("tools", lambda t: F.concat_ws(":", t["name"], t["type"])), ",").alias("tools"))


@query("w_group_notifications")
def w_group_notifications(spark, sf):
    folder = scratch(spark)
    d = events(spark, sf).where("event_type = 'error'").select(
        "node", F.explode(F.array(F.struct(F.col("ts").alias("ts"), F.lit(1).alias("delta")),
                                  F.struct(F.timestamp_micros(F.col("us") + F.col("cents") * 100000).alias("ts"), F.lit(-1).alias("delta")))).alias("e")).select("node", "e.*")
    return drained(spark, W.group_notifications(staged(spark, d, folder), ["node"]), folder)


def fixed_judge(prompts):
    """Stand-in scorer: a reply that depends only on the prompt."""
    return [f'ok {{"correctness": {len(p) % 10 / 10}, "helpfulness": 0.5, "hallucination_free": 1.5}}' if len(p) % 3 else "no idea" for p in prompts]


@query("w_judge_batches", f"""WITH {TRACES}, p AS (SELECT id, {JUDGED} AS prompt FROM tr WHERE a IS NOT NULL AND q IS NOT NULL AND {TRIM.format(c='a')} <> '' AND conv_id % 4 <> 3),
       s AS (SELECT id, length(prompt) AS n FROM p WHERE length(prompt) % 3 <> 0)
       SELECT id, name, value::DOUBLE AS value, 'judge' AS category_name, 'sdk' AS source FROM (SELECT id, 'correctness' AS name, n % 10 / 10 AS value FROM s
       UNION ALL SELECT id, 'helpfulness', 0.5 FROM s UNION ALL SELECT id, 'hallucination_free', 1.0 FROM s)""")
def w_judge_batches(spark, sf):
    folder = scratch(spark)
    s = staged(spark, traces(spark, sf), folder)
    W.judge_batches(s, fixed_judge, "proj", "judge", f"{folder}/scores", f"{folder}/ck", once=True).awaitTermination()
    return spark.read.schema("id string, name string, value double, category_name string, source string").json(f"{folder}/scores").select("id", "name", "value", "category_name", "source")


@query("w_backfill", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def w_backfill(spark, sf):
    folder = scratch(spark)
    d = events(spark, sf).select("event_id", "event_type")
    W.backfill_then_follow(staged(spark, d, folder), lambda b, e: b.write.mode("append").parquet(f"{folder}/out"), f"{folder}/ck", follow=False)
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("j_zero_fill", """SELECT n_name AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1""")
def j_zero_fill(spark, sf):
    facts = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    dim = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return ST.zero_fill(dim, facts, ["key"], ["n"]).select("name", "n")


@query("s_read_requests", ORACLES["r_request_facts"])
def s_read_requests(spark, sf):
    """Recorded calls written as JSON lines, read back, and their facts."""
    folder = scratch(spark)
    request_rows(spark, sf).write.json(f"{folder}/calls")
    return r_request_facts(spark, sf, RD.read_requests(spark, f"{folder}/calls"))


@query("s_read_bench_reports", """SELECT 'r' || l_linenumber AS report, l_returnflag AS label, count(*) AS requests, round(max(l_extendedprice), 4)::DOUBLE AS wall_s FROM lineitem GROUP BY ALL""")
def s_read_bench_reports(spark, sf):
    """A report file per level with a run per flag, read back as runs."""
    folder = scratch(spark)
    runs = table(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.count(F.lit(1)).alias("requests"), F.max("l_extendedprice").cast("double").alias("wall_s"))
    run_ = F.struct(F.col("l_returnflag").alias("label"), "requests", "wall_s")
    reports = runs.groupBy("l_linenumber").agg(F.collect_list(run_).alias("runs")).select(
        "l_linenumber", F.to_json(F.struct(F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("label"), "runs"), {"pretty": "true"}).alias("value"))
    reports.write.partitionBy("l_linenumber").text(f"{folder}/reports")
    got = RD.read_bench_reports(spark, f"{folder}/reports")["runs"]
    return got.select("report", "label", "requests", F.round("wall_s", 4).alias("wall_s"))

"""Sources, sinks and streams; every stream against its batch twin."""

import datetime as dt
import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from servelens.operators import alerts as A
from servelens.operators import logs as G
from servelens.operators import samples as S
from servelens.operators import traces as E
from servelens.sources import readers as RD
from servelens.sources import writers as WR
from servelens.streaming import streams as W
from suite.registry import flows as FL


def ts(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def run(spark, df, build, folder, splits, mode="append"):
    """Feed ``splits`` (filters, in order) as separate micro-batches."""
    for cond in splits:
        df.where(cond).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        src = spark.readStream.schema(df.schema).parquet(f"{folder}/in")

        def write(b, e):
            b.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

        (build(src).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/ck")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{folder}/out")


def test_exposition(spark):
    text = ['# TYPE x counter', 'x_total{a="1",b="q\\"\\\\n"} 5', 'up 1', '', 'y{} +Inf', 'z NaN', 'bad']
    d = RD.parse_exposition(spark.createDataFrame([(t,) for t in text], "value string"), F.lit(ts(0)))
    got = {r.metric: (r.labels, r.value) for r in d.collect()}
    assert got["x_total"] == ({"a": "1", "b": 'q"\\n'}, 5.0) and got["up"] == ({}, 1.0) and got["y"][1] == float("inf")
    assert set(got) == {"x_total", "up", "y", "z"} and got["z"][1] != got["z"][1]


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\r\n\ntwo\nthree\n")
    (tmp_path / "b.log").write_text("x\n")
    d = RD.read_log_lines(spark, str(tmp_path))
    assert sorted(r.line for r in d.collect()) == ["one", "three", "two", "x"]
    assert [r.line for r in d.where(F.col("source").endswith("a.log")).orderBy("seq").collect()] == ["one", "two", "three"]
    assert sorted(r.line for r in RD.read_log_lines(spark, str(tmp_path), tail=2).collect()) == ["three", "two", "x"]


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_lines_know_where_they_start(spark, tmp_path, split):
    """Offsets are exact however the file is split, with blank lines, carriage returns and bytes that aren't UTF-8."""
    rnd = random.Random(split)
    raw = b"".join((rnd.choice([b"", b"short", b"\xc3\xa9\xff line", b"x" * 150, b"tab\there"]) + rnd.choice([b"", b"", b"\r"])) + b"\n" for _ in range(200)) + b"last one"
    (tmp_path / "a.log").write_bytes(raw)
    want, at = [], 0
    for line in raw.split(b"\n"):
        text = line.rstrip(b"\r")
        if text:
            want.append((at, text.decode("utf-8", "replace")))
        at += len(line) + 1
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    kept = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d = RD.read_log_lines(spark, str(tmp_path))
        got = sorted((r.byte_offset, r.line) for r in d.select("byte_offset", F.make_valid_utf8("line").alias("line")).collect())
        assert got == want and d.where("seq <> byte_offset or ts is null").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_requests_reports_and_dumps(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"request_id": "1", "method": "POST", "path": "/v1/chat/completions", "body": '{"model": "m"}', "response": "{}"}))
    assert RD.read_requests(spark, str(tmp_path / "r.json")).first().model == "m"
    (tmp_path / "b.json").write_text(json.dumps({"label": "s", "runs": [{"label": "conc1", "requests": 3}], "snapshots": [{"proxy_up": 1}], "results": [{"ok": True, "turns": 2}]}, indent=1))
    rep = RD.read_bench_reports(spark, str(tmp_path / "b.json"))
    assert (rep["runs"].first().requests, rep["snapshots"].first().proxy_up, rep["results"].first().turns) == (3, 1.0, 2)
    item = {"kind": "Secret", "metadata": {"name": "n", "namespace": "k"}, "data": {}}
    (tmp_path / "live.json").write_text(json.dumps({"items": [item, {"kind": "Secret", "metadata": {}}]}))
    (tmp_path / "saved.json").write_text(json.dumps({"saved_at": "x", "state": {"secrets": {"k/n": item}}}))
    live, saved = (RD.read_resources(spark, str(tmp_path / f), "s").collect() for f in ("live.json", "saved.json"))
    assert [(r.ns, r.name) for r in live] == [(r.ns, r.name) for r in saved] == [("k", "n")]


def test_samples_table_prunes_by_metric(spark, tmp_path):
    rows = [("a", {"x": "1"}, ts(0), 1.0), ("a", {"x": "2"}, ts(86400 * 40), 2.0), ("b", {}, ts(5), 3.0)]
    d = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")
    WR.write_samples(d, str(tmp_path / "s"))
    back = WR.read_samples(spark, str(tmp_path / "s"))
    assert sorted((r.metric, r.value) for r in back.collect()) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    plan = S.select_series(back, "a", ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "metric" in plan.split("PartitionFilters")[1].split("]")[0]
    assert WR.read_samples(spark, str(tmp_path / "s"), "2024-02-12").count() == 1


def test_increments_across_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(s, ts(i), float(rnd.randint(0, 30))) for i in range(200) for s in "ab"]
    d = spark.createDataFrame(rows, "s string, ts timestamp, value double")
    got = run(spark, d, lambda x: W.counter_increments(x, ["s"]), str(tmp_path), [F.col("ts") < ts(70), F.col("ts").between(ts(70), ts(130)), F.col("ts") > ts(130)])
    batch = S.counter_increments(d, 60)
    want = {r.s: float(r.v) for r in S.total_across_resets(batch).groupBy("s").agg(F.max_by("value", "t").alias("v")).collect()}
    assert {r.s: r.v for r in got.groupBy("s").agg(F.sum("inc").alias("v")).collect()} == want
    assert got.count() == len(rows)


def test_rate_limit_across_batches(spark, tmp_path):
    rows = [("s", i, ts(i * 0.01), "x") for i in range(400)]
    d = spark.createDataFrame(rows, "source string, seq bigint, ts timestamp, line string")
    got = {r.seq: r.accepted for r in run(spark, d, lambda x: W.rate_limited(x, 10.0), str(tmp_path), ["seq < 130", "seq >= 130"]).collect()}
    assert got == {r.seq: r.accepted for r in G.rate_limit(d, 10.0, 1).collect()}


def test_many_series_share_states(spark, tmp_path):
    """3,000 series are dealt over at most ``SHARDS`` states; each keeps its own last value and is forgotten by its own time."""
    rows = [(f"k{i}" if i else None, i % 2 == 0, ts(600 * b + i % 7), float((i * 31 + b * 17) % 50)) for i in range(3000) for b in range(2)]
    rows += [(f"k{i}", i % 2 == 0, ts(20000), 100.0) for i in range(1, 3000, 3)] + [(f"k{i}", i % 2 == 0, ts(20300), 70.0) for i in range(1, 3000, 2)]
    d = spark.createDataFrame(rows, "s string, even boolean, ts timestamp, value double")
    build, splits = lambda x: W.counter_increments(x, ["s", "even"], idle="1 hour"), [F.col("ts") < ts(300), F.col("ts").between(ts(300), ts(5000)), F.col("ts") == ts(20000), F.col("ts") == ts(20300)]
    got = run(spark, d, build, str(tmp_path / "a"), splits)
    want, before = [], {}
    for k, even, t, v in sorted(rows, key=lambda r: r[2]):
        last = before.get(k)
        # the third batch still finds the series of the first two, which are forgotten before the fourth
        known = last is not None and not (t == ts(20300) and last[0] < ts(20000))
        want.append((str(k), even, t, 0.0 if not known else v - last[1] if v >= last[1] else v))
        before[k] = t, v
    assert sorted((str(r.s), r.even, r.ts, r.inc) for r in got.collect()) == sorted(want)
    assert kept_state(spark, d, build, str(tmp_path / "b"), splits[:1]) <= W.SHARDS


class PythonMemory(threading.Thread):
    """``most``: the largest resident set, in MB, of a Python process below this one while the block ran."""

    def __enter__(self):
        self.daemon, self.most, self.ended = True, 0, False
        self.start()
        return self

    def __exit__(self, *_):
        self.ended = True
        self.join()

    def run(self):
        while not self.ended:
            seen = {}
            for pid in filter(str.isdigit, os.listdir("/proc")):
                try:
                    with open(f"/proc/{pid}/stat") as f:
                        name, rest = f.read().split("(", 1)[1].rsplit(")", 1)
                    seen[int(pid)] = int(rest.split()[1]), name, int(rest.split()[21]) * os.sysconf("SC_PAGE_SIZE") >> 20
                except OSError:
                    pass
            for pid, (parent, name, size) in seen.items():
                while parent in seen and parent != os.getpid():
                    parent = seen[parent][0]
                if parent == os.getpid() and name.startswith("python"):
                    self.most = max(self.most, size)
            time.sleep(0.1)


def test_rate_limit_holds_no_lines(spark, tmp_path):
    """320 MB of one source's lines in one micro-batch pass through Python without being held there; PySpark itself keeps up to 57 of its batches."""
    text = F.repeat(F.sha2(F.col("id").cast("string"), 256), 50)
    d = spark.range(0, 100_000, 1, 8).select(F.lit("s").alias("source"), F.col("id").alias("seq"), F.timestamp_millis(F.lit(1704067200000) + F.pmod(F.col("id") * 7919, F.lit(100_000)) * 10).alias("ts"), text.alias("line"))
    d.write.parquet(str(tmp_path / "lines"))
    d = spark.read.parquet(str(tmp_path / "lines"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        with PythonMemory() as memory:
            got = run(spark, d, lambda x: W.rate_limited(x, 10.0), str(tmp_path), [F.lit(True)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert memory.most < 600
    want = G.rate_limit(d, 10.0, 60).select("seq", "accepted", F.crc32(F.col("line").cast("binary")).alias("c"))
    told = got.select("seq", "accepted", F.crc32(F.col("line").cast("binary")).alias("c"))
    assert told.count() == 100_000 and told.exceptAll(want).count() == 0


def test_alert_states_across_batches(spark, tmp_path):
    base = 1_704_067_200
    rows = [("a", base + t, 1.0) for t in (0, 30, 60, 90, 150, 180, 240)]
    d = spark.createDataFrame(rows, "node string, t bigint, value double")
    got = run(spark, d, lambda x: W.alert_states(x, ["node"], 60, 30), str(tmp_path), [f"t < {base + 60}", f"t between {base + 60} and {base + 150}", f"t > {base + 150}"])
    want = A.alert_states(d, 60, 30)
    assert sorted((r.t, r.state, r.active_since) for r in got.collect()) == sorted((r.t, r.state, r.active_since) for r in want.collect())


def test_stream_assembly_waits_for_the_end(spark, tmp_path):
    def chunk(r, i, text):
        return (r, i, ts(i), "data: " + (text if text == "[DONE]" else json.dumps({"choices": [{"delta": {"content": text}}]})))
    rows = [chunk("a", 0, "x"), chunk("a", 5, "y"), chunk("a", 6, "[DONE]"), chunk("b", 1, "lost"), chunk("c", 5000, "late"), chunk("c", 9000, "[DONE]")]
    d = spark.createDataFrame(rows, "request_id string, seq bigint, recv_ts timestamp, payload string")
    got = run(spark, d, lambda x: W.assemble_streams(x, "1 minute"), str(tmp_path), ["seq < 5", "seq between 5 and 10", "seq = 5000", "seq = 9000"])
    assert {r.request_id: r.content for r in W.streamed_requests(got).collect()} == {"a": "xy", "b": "lost", "c": "late"}


def test_a_chunk_after_the_end_gives_no_second_row(spark, tmp_path):
    rows = [("a", 0, ts(0), "data: {}"), ("a", 1, ts(1), "data: [DONE]"), ("a", 2, ts(2), "data: [DONE]"), ("a", 3, ts(70), "data: {}"),
            ("b", 0, ts(40), "data: {}"), ("z", 0, ts(100000), "data: {}")]
    d = spark.createDataFrame(rows, "request_id string, seq bigint, recv_ts timestamp, payload string")
    got = run(spark, d, lambda x: W.assemble_streams(x, "1 minute"), str(tmp_path), ["seq < 2 and request_id = 'a'", "seq = 2", "request_id = 'b'", "seq = 3", "request_id = 'z'"])
    assert sorted((r.request_id, len(r.chunks)) for r in got.where("request_id < 'z'").collect()) == [("a", 2), ("b", 1)]


def test_facts_follow_from_files(spark, tmp_path):
    lines = [{"request_id": "r", "seq": i, "recv_ts": "2024-01-01T00:00:0%d" % i, "payload": p} for i, p in enumerate(
        ['data: {"choices": [{"delta": {"content": "two "}}]}', 'data: {"choices": [{"delta": {"content": "words"}, "finish_reason": "stop"}]}', "data: [DONE]"])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.json").write_text("\n".join(json.dumps(x) for x in lines))
    W.follow_request_facts(W.follow_chunks(spark, str(tmp_path / "in")), lambda b, e: b.select("request_id", "content", "completion_tokens", "finish_reason").write.mode("append").parquet(str(tmp_path / "out")),
                           str(tmp_path / "ck"), once=True).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("r", "two words", 2, "stop")]


def kept_state(spark, df, build, folder, splits):
    """Rows of state after the last micro-batch."""
    for cond in splits:
        df.where(cond).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = (build(spark.readStream.schema(df.schema).parquet(f"{folder}/in")).writeStream.outputMode("append").format("noop")
             .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    return q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("kind", ["bucket", "counter", "alert", "chunks"])
def test_idle_keys_leave_no_state(spark, tmp_path, kind):
    """A hundred keys come and go; once time has passed them, one far later key is all that is kept."""
    rows = [(f"k{i}", i, ts(i), i, 1.0, "data: [DONE]") for i in range(100)] + [("far", 1000, ts(10**6), 10**6, 1.0, "data: {}")]
    d = spark.createDataFrame(rows, "source string, seq bigint, ts timestamp, sec bigint, value double, line string")
    build = {"bucket": lambda x: W.rate_limited(x, 10.0), "counter": lambda x: W.counter_increments(x, ["source"], idle="1 hour"),
             "alert": lambda x: W.alert_states(x.withColumnRenamed("sec", "t"), ["source"], 60, 30),
             "chunks": lambda x: W.assemble_streams(x.select(F.col("source").alias("request_id"), "seq", F.col("ts").alias("recv_ts"), F.col("line").alias("payload")))}[kind]
    assert kept_state(spark, d, build, str(tmp_path), ["seq < 50", "seq < 100 and seq >= 50", "seq = 1000"]) == 1


def test_notifications_across_batches(spark, tmp_path):
    d = spark.createDataFrame([("g", ts(0), 1), ("g", ts(1000), -1), ("z", ts(20000), 1), ("z", ts(40000), 1)], "node string, ts timestamp, delta int")
    got = run(spark, d, lambda x: W.group_notifications(x, ["node"], "0 seconds"), str(tmp_path), [F.col("ts") < ts(500), F.col("ts") == ts(1000), F.col("ts") == ts(20000), F.col("ts") > ts(30000)])
    base = int((ts(0) - dt.datetime(1970, 1, 1)).total_seconds())
    assert sorted((r.t - base, r.n_firing, r.reason) for r in got.where("node = 'g'").collect()) == [(30, 1, "changed"), (1230, 0, "resolved")]


def test_notifications_pass_each_change_once(spark, tmp_path):
    """A group's changes are not looked through at every flush: 120,000 of them over 8,640 slots took minutes."""
    n = 120_000
    d = spark.range(n).select(F.lit("g").alias("node"), F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") * 21.6).cast("long")).alias("ts"), F.lit(1).alias("delta"))
    began = time.monotonic()
    got = run(spark, d, lambda x: W.group_notifications(x, ["node"], "0 seconds"), str(tmp_path), [F.lit(True)]).orderBy("t").collect()
    assert time.monotonic() - began < 60
    base = 1704067200
    assert [(r.t, r.n_firing, r.reason) for r in got] == [(t, min(n, int((t - base + 1) / 21.6 + 1 - 1e-9)), "changed") for t in range(base + 30, base + int((n - 1) * 21.6) + 1, 300)]


def fixed():
    """A scorer defined locally, so that it travels to the workers by value."""
    def judge(prompts):
        return ['{"correctness": 2, "helpfulness": 0.5, "hallucination_free": 0}' for _ in prompts]
    return judge


def traces(spark):
    rows = [("1", ts(1), [("user", " hi ")], "yes", []), ("2", ts(2), [("user", "")], "yes", []), ("3", ts(3), [("user", "q")], "a", [(n, 1.0) for n in E.JUDGE_NAMES])]
    d = spark.createDataFrame(rows, "id string, start_time timestamp, m array<struct<role string, content string>>, a string, feedback_scores array<struct<name string, value double>>")
    return d.select("id", "start_time", F.struct(F.col("m").alias("messages")).alias("input"), F.struct(F.col("a").alias("content")).alias("output"), "feedback_scores")


def test_judge_pass(spark, tmp_path):
    got = {r["name"]: r["value"] for r in E.judge_once(traces(spark), None, fixed(), "p", "why").collect()}
    assert got == {"correctness": 1.0, "helpfulness": 0.5, "hallucination_free": 0.0}
    d = traces(spark)
    d.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        src = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        W.judge_batches(src, fixed(), "p", "why", str(tmp_path / "scores"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.json(str(tmp_path / "scores")).count() == 3
    assert [p.name for p in (tmp_path / "scores").iterdir() if p.is_dir()] == ["day=2024-01-01"]  # what a batch reads back


@pytest.mark.parametrize("reply,ok", [("no json", False), ('x {"correctness": 1, "helpfulness": 1} y', False), ('{"correctness": "a", "helpfulness": 1, "hallucination_free": 1}', False),
                                      ('ok\n{"correctness": "0.4",\n"helpfulness": true, "hallucination_free": -3} bye', True), ("{broken", False)])
def test_judge_replies(spark, reply, ok):
    r = spark.createDataFrame([(reply,)], "r string").select(E.parse_judge_reply(F.col("r")).alias("s")).first().s
    assert (tuple(r) == (0.4, 1.0, 0.0)) if ok else r is None


@pytest.mark.parametrize("times,kind", [([1 << 62, 1 << 61], "bigint"), ([1 << 62] * 3, "decimal(38,0)")])
def test_log_times_add_up_beyond_a_long(spark, times, kind):
    d = spark.createDataFrame([(t,) for t in times], "us bigint").agg(F.sum(F.col("us").cast("decimal(20,0)")).cast("decimal(38,0)").alias("us"))
    got = FL.narrowed(d, "us")
    assert dict(got.dtypes)["us"] == kind and int(got.first().us) == sum(times)


def test_otlp_logs_of_many_lines(spark, tmp_path):
    spark.range(12000).select(F.col("id").alias("event_id"), F.lit(ts(0)).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"),
                              F.lit(1.0).alias("value"), F.lit('{"k": 7}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    (got,) = FL.s_read_otlp_logs(spark, str(tmp_path)).collect()
    assert got.n == 12000 and int(got.us) == 12000 * 1704067200 * 10**6


def test_windows_open_at_the_end_are_told(spark, tmp_path):
    schema = "source string, ts timestamp, line string"
    for i, seconds in enumerate(([0, 10, 3500], [3550, 3700], [3710, 3720])):
        spark.createDataFrame([("s", ts(x), "GET /") for x in seconds], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = FL.drained(spark, W.line_counts(stream, "1 hour"), str(tmp_path), ["start", "severity", "category"])
    assert sorted((r.start, r.category, r.n) for r in got.collect()) == [(ts(0), "http", 4), (ts(3600), "http", 3)]


def test_windowed_counts(spark, tmp_path):
    d = spark.createDataFrame([(ts(i), "error" if i % 5 == 0 else "plain") for i in range(180)], "ts timestamp, line string")
    got = run(spark, d, lambda x: W.line_counts(x), str(tmp_path), ["1 = 1"], "complete")
    assert {(r.severity, r.n) for r in got.collect()} == {("error", 12), ("info", 48)}

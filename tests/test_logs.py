"""Log classification, rate limit, crash reasons, cache blocks and drift."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from servelens.operators import drift as D
from servelens.operators import host as H
from servelens.operators import logs as G


def ts(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.mark.parametrize("line,want", [
    ("[metal] gpu error", ("error", "gpu")), ("rank 1 is down", ("warning", "rank")), ("Traceback: POST /x", ("error", "python")),
    ("request failed", ("error", "python")), ("prefill 10 tokens/s", ("info", "generation")), ("GET /v1/models", ("info", "http")),
    ("get /v1/models", ("info", "other")), ("unfailed", ("info", "other"))])
def test_first_match_wins(spark, line, want):
    r = G.classify_lines(spark.createDataFrame([(line,)], "line string")).first()
    assert (r.severity, r.category) == want


@pytest.mark.parametrize("rate", [5.0, 100.0])
def test_rate_limit_matches_a_single_bucket(spark, rate):
    rnd = random.Random(2)
    rows, t = [], 0.0
    for i in range(600):
        t += rnd.choice([0.0, 0.001, 0.01, 0.01, 0.3, 15.0 if i % 150 == 149 else 0.02])
        rows.append(("s" if i % 3 else "q", i, ts(round(t, 6)), "x"))
    got = {r.seq: r.accepted for r in G.rate_limit(spark.createDataFrame(rows, "source string, seq bigint, ts timestamp, line string"), rate, 20).collect()}
    want, cap = {}, max(rate, 50.0)
    for s in "sq":
        tokens, last = cap, None
        for _, i, w, _ in [r for r in rows if r[0] == s]:
            now = (w - ts(0)).total_seconds()
            tokens = min(cap, tokens + (0 if last is None else (now - last) * rate))
            last = now
            want[i] = tokens >= 1
            tokens -= want[i]
    assert len(got) == 600 and sum(got[i] != want[i] for i in want) == 0


def sequential(rows, rate):
    """One bucket per source over all its lines, in whole nanoseconds."""
    cost, slack, full, out = round(1e9 / rate), round((max(rate, 50.0) - 1) * round(1e9 / rate)), {}, {}
    for s, i, us in sorted(rows, key=lambda r: (r[2], r[1])):
        at = full.get(s, 0)
        if max(at, us * 1000) - us * 1000 <= slack:
            full[s] = max(at, us * 1000) + cost
            out[i] = True
        else:
            out[i] = False
    return out


@pytest.mark.parametrize(("rate", "gap"), [(7.0, 60_000), (3.0, 333_000), (20.0, 50_000), (20.0, 49_000), (13.0, 90_000)])
def test_a_source_without_pauses_is_cut(spark, rate, gap):
    """A third of all lines in one source that never rests: many slices, few rounds, one bucket's result."""
    rnd = random.Random(int(rate * gap))
    rows, us = [], 0
    for i in range(3000):
        us += rnd.randint(0, 2 * gap)
        rows.append(("hot" if i % 3 else f"s{i % 30}", i, us))
    d = spark.createDataFrame(rows, "source string, seq bigint, us bigint").withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(5)
    got = {r.seq: r.accepted for r in G.rate_limit(d, rate, 5).collect()}
    assert got == sequential(rows, rate)


def test_hot_source_uses_many_tasks(spark):
    d = spark.range(4000).select(F.lit("hot").alias("source"), F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 10_000).alias("ts"))
    starts = spark.range(8).select(F.lit("hot").alias("source"), F.col("id").alias("slice"), F.lit(None).cast("bigint").alias("start"))
    lines = d.select("source", "seq", F.unix_micros("ts").alias("us"), F.floor(F.unix_micros("ts") / 5_000_000).alias("slice"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few enough for one task
    try:
        parts = G._bucket_slices(lines, starts, 50.0, True).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


def test_rate_zero_accepts_all(spark):
    d = spark.createDataFrame([("s", i, ts(0), "x") for i in range(200)], "source string, seq bigint, ts timestamp, line string")
    assert G.rate_limit(d, 0).where("accepted").count() == 200


def lines(spark, texts, source="s"):
    rows, off = [], 0
    for i, t in enumerate(texts):
        rows.append((source, i, off, t))
        off += len(t.encode()) + 1
    return spark.createDataFrame(rows, "source string, seq bigint, byte_offset bigint, line string"), off


def test_cache_block_resets_at_total(spark):
    d, _ = lines(spark, ["Prompt Cache: 3 sequences, 1.0 GB", " - user: 2 sequences, 0.5 GB", "noise", "Prompt Cache: 10 sequences, 0.18 GB", " - assistant: 10 sequences, 0.18 GB"])
    got = {r.type: (r.sequences, round(r.bytes)) for r in G.kv_cache_blocks(d).collect()}
    assert got == {"total": (10, 180_000_000), "assistant": (10, 180_000_000), "user": (0, 0), "system": (0, 0)}


def test_types_before_any_total_count(spark):
    d, _ = lines(spark, [" - user: 2 sequences, 0.5 GB"])
    assert {r.type: r.sequences for r in G.kv_cache_blocks(d).collect()}["user"] == 2
    assert G.kv_utilization(d, F.lit(1e9)).first().utilization == pytest.approx(.05)


@pytest.mark.parametrize("texts,want", [
    (["[METAL] Command buffer execution failed"], "metal_gpu_error"), (["[METAL] fault", "reset"], "exit"), (["out of memory", "[METAL] x timeout"], "metal_gpu_error"),
    (["Traceback", "OOM"], "oom"), (["killed"], "python_error"), (["fine"], "exit"), (["killed"] + ["y" * 50] * 200, "exit")])
def test_crash_reason(spark, texts, want):
    d, size = lines(spark, texts)
    e = spark.createDataFrame([("s", 1, size)], "source string, exit_id bigint, byte_offset bigint")
    assert G.crash_reason(e, d).first().reason == want


def test_missing_log_is_unknown_and_long_lines_are_cut(spark):
    d, size = lines(spark, ["killed " + "z" * 9000, "w"])
    e = spark.createDataFrame([("s", 1, size), ("other", 2, 5)], "source string, exit_id bigint, byte_offset bigint")
    assert {r.exit_id: r.reason for r in G.crash_reason(e, d).collect()} == {1: "exit", 2: "unknown"}


def test_serving_states(spark):
    ev = ["spawn", "fail", "ok", "ok", "fail", "ok", "exit", "ok", "spawn", "ok", "exit", "spawn", "stop"]
    d = spark.createDataFrame([("s", ts(i), i, e) for i, e in enumerate(ev)], "source string, ts timestamp, seq bigint, event string")
    got = [r.state for r in G.serving_states(d, 4).orderBy("seq").collect()]
    assert got == [2, 2, 1, 1, 2, 1, 1, 1, 2, 1, 3, 2, 0]


def test_counter_delta_ignores_resets(spark):
    d = spark.createDataFrame([("n", ts(i), v) for i, v in enumerate([5, 9, 3, 4])], "node string, ts timestamp, rx bigint")
    assert [r.rx_delta for r in H.counter_delta(d, ["node"], ["rx"], slice_seconds=2).orderBy("ts").collect()] == [0, 4, 0, 1]


def test_model_facts_known_answer(spark):
    cfg = {"num_hidden_layers": 28, "num_key_value_heads": 8, "head_dim": 128, "max_position_embeddings": 40960}
    nested = {"text_config": cfg, "quantization_config": {"bits": 4}, "max_position_embeddings": 1}
    d = spark.createDataFrame([("a", json.dumps(cfg)), ("b", json.dumps(nested)), ("c", "{}"), ("d", "not json")], "model string, config string")
    got = {r.model: r for r in H.kv_bytes(H.model_facts(d)).collect()}
    assert got["a"].kv_bytes_per_token == got["b"].kv_bytes_per_token == 114688
    assert got["a"].kv_capacity_bytes == 46_976_204_800 and got["b"].quant_bits == 4
    assert got["c"].max_context == got["d"].max_context == 32768 and got["c"].kv_bytes_per_token == 0


def res(spark, source, docs):
    return spark.createDataFrame([(source, k, "ns", n, json.dumps(d)) for k, n, d in docs], "source string, kind string, ns string, name string, doc string")


def diff(spark, a, b, kind="ConfigMap"):
    a, b = (D.normalize_resources(res(spark, s, [(kind, "x", d)])) for s, d in (("a", a), ("b", b)))
    c = D.compare_states(a, b)
    return c.first().status, [(r.path, r.a, r.b) for r in D.field_diff(c, a, b).collect()]


def test_self_comparison_is_ok(spark):
    d = D.normalize_resources(res(spark, "a", [("Deployment", "x", {"spec": [1, {"a": None}]}), ("Pod", "y", {}), ("Secret", "", {})]))
    assert [r.status for r in D.compare_states(d, d).collect()] == ["OK"]


def test_volatile_fields_do_not_drift(spark):
    a = {"metadata": {"uid": "1", "annotations": {"deployment.kubernetes.io/revision": "1"}}, "status": 3, "data": {"k": "v"}}
    assert diff(spark, a, {"metadata": {"uid": "2"}, "data": {"k": "v"}}) == ("OK", [])


def test_field_diff_paths(spark):
    a = {"spec": {"n": 1, "gone": {"deep": [1]}, "c": [{"name": "b", "v": 1}, {"name": "a", "v": 2}], "l": [1, 2, 3], "t": True}}
    b = {"spec": {"n": 2, "c": [{"name": "a", "v": 2}, {"name": "b", "v": 9}], "l": [1, 5], "t": True}, "new": "x"}
    status, rows = diff(spark, a, b, "Deployment")
    assert status == "DIFF" and sorted(rows) == sorted([
        ("new", None, "x"), ("spec.n", "1", "2"), ("spec.gone", '{"deep": [1]}', None), ("spec.c[1].v", "1", "9"), ("spec.l[1]", "2", "5"), ("spec.l[2]", "3", None)])


def test_field_diff_never_broadcasts_entries(spark):
    a = D.normalize_resources(res(spark, "a", [("ConfigMap", f"x{i}", {"spec": {"v": i}}) for i in range(20)]))
    b = D.normalize_resources(res(spark, "b", [("ConfigMap", f"x{i}", {"spec": {"v": i % 10}}) for i in range(20)]))
    got = D.field_diff(D.compare_states(a, b), a, b)
    assert sorted((r.name, r.path, r.a, r.b) for r in got.collect()) == sorted((f"x{i}", "spec.v", str(i), str(i - 10)) for i in range(10, 20))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_secrets_show_digests_only(spark):
    d = D.documents(D.normalize_resources(res(spark, "a", [("Secret", "x", {"data": {"p": "c2VjcmV0"}})]))).first()
    assert json.loads(d.doc)["data"]["p"] == D.digest_text("secret") and "c2VjcmV0" not in d.doc
    assert D.secret_values(res(spark, "a", [("Secret", "x", {"data": {"p": "c2VjcmV0"}})])).first().value == "secret"


def test_binary_config_data_is_decoded(spark):
    assert diff(spark, {"binaryData": {"k": "dg=="}}, {"data": {"k": "v"}}) == ("OK", [])


@pytest.mark.parametrize("kind", ["Secret", "ConfigMap"])
@pytest.mark.parametrize("data", [{"data": None}, {"data": {}}, {"data": None, "binaryData": None}])
def test_null_data_counts_as_none(spark, kind, data):
    if kind == "Secret":
        data.pop("binaryData", None)
    assert diff(spark, data, {}, kind) == ("OK", [])


def test_keys_and_values_with_control_characters(spark):
    odd = {"a\x01b": {"\x02": ["x\x01\x02", "\x03", {"\x03\x032": 1}]}, "\x031": "\x00"}
    assert diff(spark, {"spec": odd}, {"spec": odd}, "Deployment") == ("OK", [])
    d = D.documents(D.normalize_resources(res(spark, "a", [("Deployment", "x", {"spec": odd})]))).first()
    assert json.loads(d.doc) == {"spec": odd}
    other = json.loads(json.dumps(odd))
    other["a\x01b"]["\x02"][1] = "y"
    assert diff(spark, {"spec": odd}, {"spec": other}, "Deployment") == ("DIFF", [("spec.a\x01b.\x02[1]", "\x03", "y")])


def test_annotations_that_become_empty_go_and_others_stay(spark):
    note = {"kubectl.kubernetes.io/last-applied-configuration": "x"}
    assert diff(spark, {"metadata": {"annotations": note, "n": 1}}, {"metadata": {"n": 1}})[0] == "OK"
    assert diff(spark, {"metadata": {"annotations": {**note, "k": {}}}}, {"metadata": {"annotations": {"k": {}}}})[0] == "OK"
    assert diff(spark, {"metadata": {"annotations": {**note, "k": "v"}}}, {"metadata": {}})[0] == "DIFF"


def test_a_large_document_takes_linear_time(spark):
    big = {"spec": {f"k{i}": {"annotations": {}, "v": i} for i in range(20000)}}
    t = time.perf_counter()
    assert len(D._entries("deployments", json.dumps(big))) == 40002
    assert time.perf_counter() - t < 5


def test_equal_documents_are_never_spelled(spark):
    """One Python pass a side; the digests alone are compared."""
    a, b = (D.normalize_resources(res(spark, s, [("ConfigMap", "x", {"data": {"k": s}})])) for s in "ab")
    plan = D.compare_states(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2 and "PythonUDF" not in plan

"""Streams, tool calls and request facts."""

import datetime as dt
import json

from pyspark.sql import functions as F

from servelens.operators import requests as R

T = dt.datetime(2024, 1, 1)


def stream(spark, *payloads):
    rows = [("r", i, T + dt.timedelta(milliseconds=i), "data: " + (p if isinstance(p, str) else json.dumps(p))) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "request_id string, seq bigint, recv_ts timestamp, payload string")


def delta(finish=None, **d):
    return {"choices": [{"finish_reason": finish, "delta": d}]}


def call(cid=None, name=None, typ=None, args=""):
    fn = {"arguments": args, **({"name": name} if name is not None else {})}
    return {**({"id": cid} if cid else {}), **({"type": typ} if typ else {}), "function": fn}


def test_stream_content_usage_and_finish(spark):
    d = stream(spark, delta(content="Hello"), "{broken", delta(content=" world"), delta("stop"), {"choices": [], "usage": {"completion_tokens": 2}}, "[DONE]")
    r = R.assemble_stream(d).first()
    assert (r.content, r.finish_reason, r.usage.completion_tokens, r.t_first) == ("Hello world", "stop", 2, T)


def test_split_tool_name_and_fragments_without_id(spark):
    d = stream(spark, delta(tool_calls=[call("c1", "read", "function")]), delta(tool_calls=[call("c1", "_file")]),
               delta(tool_calls=[call("c1", "")]), delta(tool_calls=[call(None, "lost")]))
    assert [tuple(t) for t in R.assemble_stream(d).first().tools] == [("read_file", "function")]


def test_tool_name_falls_back(spark):
    d = stream(spark, delta(tool_calls=[{"id": "c1"}]))
    assert [tuple(t) for t in R.assemble_stream(d).first().tools] == [("unknown", "unknown")]


def test_last_chunk_with_choices_decides_the_finish_reason(spark):
    assert R.assemble_stream(stream(spark, delta("stop"), delta(None, content="x"))).first().finish_reason is None


def test_null_usage_overwrites(spark):
    r = R.assemble_stream(stream(spark, {"usage": {"completion_tokens": 4}, "choices": []}, {"usage": None, "choices": []})).first()
    assert r.usage is None


def test_tool_args_by_index(spark):
    def part(i, **fn):
        return delta(tool_calls=[{"index": i, "function": fn}])
    d = stream(spark, part(0, name="a", arguments="{"), part(1, arguments="x"), part(0, arguments="}"))
    assert [tuple(r) for r in R.assemble_tool_args(d).collect()] == [("r", 0, "a", "{}")]


def raw(spark, rows):
    schema = ("request_id string, method string, path string, headers map<string,string>, body string, status int, response string, "
              "t_arrival double, t_send double, t_first double, t_done double")
    base = dict(method="POST", path="/v1/chat/completions", headers={}, body="{}", status=200, response="{}", t_arrival=0.0, t_send=1.0, t_first=None, t_done=3.0)
    return spark.createDataFrame([tuple({"request_id": str(i), **base, **r}[c.split()[0]] for c in schema.split(", ")) for i, r in enumerate(rows)], schema)


def facts(spark, rows, **kw):
    return R.request_facts(R.parse_responses(R.parse_requests(raw(spark, rows), **kw))).orderBy("request_id").collect()


RESP = json.dumps({"choices": [{"finish_reason": "tool_calls", "message": {"content": "four words of text", "tool_calls": [call("c", "f", "function"), {"id": "d"}]}}],
                   "usage": {"prompt_tokens": 5, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 42}}})


def test_facts_from_usage(spark):
    r = facts(spark, [{"response": RESP, "body": json.dumps({"model": "m", "enable_thinking": True})}])[0]
    assert (r.model, r.kind, r.prompt_tokens, r.completion_tokens, r.cached_tokens, r.cache_ratio) == ("m", "reasoning", 5, 2, 42, 1.0)
    assert [tuple(t) for t in r.tools] == [("f", "function"), ("unknown", "unknown")]
    assert (r.queue_wait, r.gen_seconds, r.ttft_seconds, r.token_rate, r.finish_reason) == (1.0, 2.0, 2.0, 1.0, "tool_calls")


def test_facts_without_usage_count_words(spark):
    body = json.dumps({"messages": [{"role": "user", "content": "one two"}, {"role": "user", "content": "three"}]})
    resp = json.dumps({"choices": [{"message": {"content": "a b c"}}]})
    r = facts(spark, [{"body": body, "response": resp}])[0]
    assert (r.prompt_tokens, r.completion_tokens, r.cache_ratio, r.finish_reason) == (3, 3, None, "unknown")


def test_destreamed_has_no_first_token_time(spark):
    r = facts(spark, [{"body": '{"stream": true}'}], top=5, sample=1.0)[0]
    assert r.lp_source == "destreamed" and r.ttft_seconds is None


def test_other_calls_are_not_completions(spark):
    assert facts(spark, [{"method": "GET", "path": "/v1/models"}, {"path": "/v1/models"}]) == []


def test_scoring_plan(spark):
    got = facts(spark, [{"body": '{"logprobs": true}'}, {"body": '{"logprobs": true, "stream": true}'}, {"body": "{}"}], top=3)
    assert [r.lp_source for r in got] == ["client", "", "injected"]
    assert [r.lp_source for r in facts(spark, [{"body": "{}"}])] == [""]


def test_strip_logprobs(spark):
    d = spark.createDataFrame([(json.dumps({"choices": [{"index": 0, "logprobs": {"content": []}, "finish_reason": "stop"}]}),), ('{"choices": [{"index": 0}]}',), ("{}",)], "response string")
    got = R.strip_logprobs(d).collect()
    assert [r.logprobs_removed for r in got] == [True, False, False]
    assert got[0].choices == [{"index": "0", "finish_reason": "stop"}]


def test_status_class(spark):
    d = spark.createDataFrame([(200,), (404,), (503,), (None,)], "s int").select(R.status_class(F.col("s")).alias("c"))
    assert [r.c for r in d.collect()] == [None, "4xx", "5xx", "5xx"]

"""Text heuristics and token confidence against known answers."""

import json
import math

import pytest
from pyspark.sql import functions as F

from servelens.functions import confidence as C
from servelens.functions import text as Q
from servelens.functions.scalars import parse_size
from servelens.operators import requests as R


def content(*tokens):
    """(probability, [candidate probabilities]) -> logprobs JSON."""
    return json.dumps({"content": [
        {"token": "x", "logprob": math.log(p), **({"top_logprobs": [{"token": "t", "logprob": math.log(q)} for q in top]} if top else {})}
        for p, top in tokens]})


def score(spark, texts, threshold=0.5):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    d = R.score_confidence(d, F.from_json("j", C.LOGPROBS_SCHEMA)["content"], threshold)
    return [r.asDict() for r in d.orderBy("i").collect()]


def test_perplexity_and_spread(spark):
    a, b, c, e = score(spark, [content((1, 0), (1, 0), (1, 0)), content((.5, 0), (.5, 0), (.5, 0)), content((.2, 0), (.8, 0)), content((.7, 0))])
    assert a["perplexity"] == pytest.approx(1.0, abs=1e-9)
    assert b["perplexity"] == pytest.approx(2.0, abs=1e-9)
    assert c["confidence_mean"] == pytest.approx(.5) and c["confidence_std"] == pytest.approx(.42426406871, abs=1e-6) and c["confidence_min"] == pytest.approx(.2)
    assert e["confidence_std"] == 0.0 and e["confidence_mean"] == pytest.approx(.7)


def test_entropy(spark):
    one, half, trunc, none = score(spark, [content((1, [1.0])), content((.5, [.5, .5])), content((.3, [.3, .3])), content((.5, 0))])
    assert one["entropy"] < 1e-9 and none["entropy"] == 0.0
    assert half["entropy"] == pytest.approx(math.log(2), abs=1e-9)
    assert trunc["entropy"] == pytest.approx(math.log(2), abs=1e-9)


def test_margin(spark):
    top, flip, lone = score(spark, [content((.9, [.9, .05])), content((.5, [.5, .5])), content((1, [1.0]))])
    assert top["margin_mean"] == pytest.approx(.85, abs=1e-9)
    assert flip["margin_mean"] == 0.0 and lone["margin_mean"] == 0.0


def test_low_ratio_and_summary(spark):
    t = content((.9, 0), (.4, 0), (.2, 0))
    assert score(spark, [t])[0]["low_confidence_ratio"] == pytest.approx(2 / 3)
    assert score(spark, [t], 0.1)[0]["low_confidence_ratio"] == 0.0
    full = score(spark, [content((.9, [.9, .05]), (.3, [.3, .3]))])[0]
    assert full["scored_tokens"] == 2 and full["confidence_min"] == pytest.approx(.3) and 1 < full["perplexity"] < 3


def test_unusable_payloads_score_null(spark):
    junk = [None, "{}", "[]", '"logprobs"', "42", '{"content": null}', '{"content": []}', '{"content": [{}]}', '{"content": [{"logprob": "not-a-number"}]}']
    assert all(r["perplexity"] is None and r["scored_tokens"] is None for r in score(spark, junk))


@pytest.mark.parametrize("broken", ['"nope"', "[]", "[{}]", '[{"logprob": "x"}]'])
def test_broken_candidates_keep_confidence(spark, broken):
    out = score(spark, ['{"content": [{"logprob": -0.5, "top_logprobs": %s}]}' % broken])[0]
    assert out["scored_tokens"] == 1 and out["confidence_mean"] == pytest.approx(math.exp(-.5))
    assert out["entropy"] == 0.0 and out["margin_mean"] == 0.0


def test_entries_without_logprob_are_skipped(spark):
    assert score(spark, ['{"content": [{"token": "a"}, {"token": "b", "logprob": -0.1}]}'])[0]["scored_tokens"] == 1


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


def test_repetition(spark):
    assert one(spark, Q.repetition, "red fox runs") == 0.0
    # ten content words, eight trigrams, "red fox runs" three times
    text = "Red fox, runs! red fox runs red fox runs far"
    assert one(spark, Q.repetition, text) == pytest.approx(3 / 8)
    assert one(spark, Q.repetition, "") == 0.0 and one(spark, Q.repetition, None) == 0.0
    assert one(spark, Q.repetition, "the and of " * 20) == 0.0


def test_refusal_and_hedging(spark):
    assert one(spark, Q.refusal, "Sorry, I CAN'T do that") == 1.0
    assert one(spark, Q.refusal, "there is no information on it") == 1.0
    assert one(spark, Q.refusal, "naive icant") == 0.0
    assert one(spark, Q.hedging, "maybe maybe unlikely") == pytest.approx(.6)
    assert one(spark, Q.hedging, "maybe " * 9) == 1.0


def test_ungrounded_needs_offered_tools(spark):
    def f(offered, calls):
        return lambda t: Q.ungrounded(t, F.lit(offered), F.lit(calls))
    assert one(spark, f(True, 0), "in 1999") == 1.0
    assert one(spark, f(True, 1), "in 1999") == 0.0
    assert one(spark, f(False, 0), "in 1999") == 0.0
    assert one(spark, f(True, 0), "long ago") == 0.0


@pytest.mark.parametrize("text,size", [("505.6MB", 530160025), ("1.23GiB", 1320702443), ("7PB", 7), ("junk", 0), ("12B", 12), ("1KB", 1024)])
def test_parse_size(spark, text, size):
    assert one(spark, parse_size, text) == size


def test_word_count_uses_unicode_blanks(spark):
    assert one(spark, Q.word_count, " a b c\n\td ") == 4
    assert one(spark, Q.word_count, None) == 0

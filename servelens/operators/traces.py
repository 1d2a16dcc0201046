"""Traces, feedback scores and judge replies."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .slices import join_on, micros
from .stats import percentiles

# Judge score names, prompt text and score attributes.
JUDGE_NAMES = ("correctness", "helpfulness", "hallucination_free")
JUDGE_PROMPT = (
    "You are an evaluator. Score the assistant's answer to the user's question using three numbers between 0 and 1.\n\n"
    "Question: {question}\n\n"
    "Assistant answer: {answer}\n\n"
    "Return ONLY a JSON object with exactly these keys:\n"
    '- "correctness": how factually correct and complete the answer is\n'
    '- "helpfulness": how well the answer addresses the request\n'
    '- "hallucination_free": 1.0 if the answer is fully grounded in the question and invents nothing, '
    "0.0 if it fabricates\n"
    'Example: {"correctness": 0.9, "helpfulness": 0.8, "hallucination_free": 1.0}'
)
JUDGE_CATEGORY = "judge"
JUDGE_SOURCE = "sdk"


def question_answer(traces: DataFrame) -> DataFrame:
    """Add ``question`` (last user message with content) and ``answer``, trimmed."""
    user = F.filter(F.col("input.messages"), lambda m: (m["role"] == "user")
                    & (F.coalesce(m["content"], F.lit("")) != ""))
    q = F.try_element_at(user, F.lit(-1))["content"]
    usable = F.col("output").isNotNull() & (F.coalesce(F.size("input.messages"), F.lit(0)) > 0)
    return traces.withColumns({
        "question": F.when(usable, strip(F.coalesce(q, F.lit("")))),
        "answer": F.when(usable, strip(F.coalesce(F.col("output.content"), F.lit(""))))})


def pending_traces(traces: DataFrame, scores: DataFrame | None = None,
                   names: tuple = JUDGE_NAMES) -> DataFrame:
    """Traces with question and answer that lack at least one judge score.

    Reads the scores nested in the trace, and/or a separate ``(id, name)``
    table, which is reduced to fully scored ids before the anti join.
    """
    d = question_answer(traces).where((F.col("question") != "") & (F.col("answer") != ""))
    if "feedback_scores" in traces.columns:
        have = F.transform(F.col("feedback_scores"), lambda s: s["name"])
        all_there = F.lit(True)
        for n in names:
            all_there = all_there & F.coalesce(F.array_contains(have, n), F.lit(False))
        d = d.where(~all_there)
    if scores is not None:
        done = (scores.where(F.col("name").isin(list(names))).groupBy("id")
                .agg(F.count_distinct("name").alias("k")).where(F.col("k") == len(names)).select("id"))
        d = d.join(done, "id", "left_anti")
    return d


def judge_prompt(question: Column, answer: Column) -> Column:
    head, rest = JUDGE_PROMPT.split("{question}")
    mid, tail = rest.split("{answer}")
    return F.concat(F.lit(head), question, F.lit(mid), answer, F.lit(tail))


def parse_judge_reply(reply: Column, names: tuple = JUDGE_NAMES) -> Column:
    """Struct of the judge scores clamped to 0..1, null unless all are usable.

    Takes the widest ``{...}`` of a noisy reply, across lines.
    """
    body = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    doc = F.try_parse_json(body)

    def score(n):
        text = F.try_variant_get(doc, f"$.{n}", "string")
        num = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), num))

    # greatest/least skip nulls, so usability is tested on the raw text
    ok = F.lit(True)
    for n in names:
        text = F.try_variant_get(doc, f"$.{n}", "string")
        ok = ok & F.coalesce(text.isin("true", "false") | text.try_cast("double").isNotNull(), F.lit(False))
    return F.when(ok, F.struct(*[score(n).alias(n) for n in names]))


def score_rows(replies: DataFrame, project: str, reason: str, names: tuple = JUDGE_NAMES) -> DataFrame:
    """``(id, reply)`` -> one row per trace and judge score; unparseable replies vanish."""
    d = replies.withColumn("_s", parse_judge_reply(F.col("reply"), names)).where("_s is not null")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col("_s")[n].alias("value")) for n in names])
    return d.select("id", F.explode(rows).alias("r")).select(
        "id", "r.name", "r.value", F.lit(JUDGE_CATEGORY).alias("category_name"), F.lit(reason).alias("reason"),
        F.lit(project).alias("project_name"), F.lit(JUDGE_SOURCE).alias("source"))


def merge_scores(base: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """Upsert by (id, name): the row with the highest version wins.

    ``max_by`` keeps one row per key map-side before the shuffle.
    """
    key = ["id", "name"]
    rest = [c for c in base.columns if c not in key]
    both = base.unionByName(new.select(*base.columns))
    return (both.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_r"))
            .select(*key, *[F.col("_r")[c].alias(c) for c in rest]))


def _score_named(name: str) -> Column:
    """First nested score of that name."""
    hit = F.filter("feedback_scores", lambda s: s["name"] == name)
    return F.get(F.transform(hit, lambda s: s["value"]), F.lit(0))


def trace_stats(traces: DataFrame, price_per_token: float, by: list[str] = ("project",)) -> DataFrame:
    """Count, duration percentiles, errors, tokens, cost and mean judge scores."""
    d = traces.withColumn("duration", (micros("end_time") - micros("start_time")) / 1e6)
    judge = [F.avg(_score_named(n)).alias(n) for n in JUDGE_NAMES]
    total = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("traces"), F.sum(F.when(F.col("error_info").isNotNull(), 1).otherwise(0)).alias("errors"),
        F.coalesce(F.sum("usage.total_tokens"), F.lit(0)).alias("total_tokens"),
        (F.coalesce(F.sum("usage.total_tokens"), F.lit(0)) * price_per_token).alias("cost"), *judge)
    p = percentiles(d, list(by), "duration", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return join_on(total, p, list(by), "left")


def trace_trends(traces: DataFrame, step: int, price_per_token: float, by: list[str] = ()) -> DataFrame:
    """Per time bucket: volume, mean duration, tokens, cost and error rate."""
    t = (F.floor(micros("start_time") / (step * 1_000_000)) * step).cast("bigint").alias("t")
    return traces.groupBy(t, *by).agg(
        F.count(F.lit(1)).alias("traces"),
        F.avg((micros("end_time") - micros("start_time")) / 1e6).alias("mean_duration"),
        F.coalesce(F.sum("usage.total_tokens"), F.lit(0)).alias("total_tokens"),
        (F.coalesce(F.sum("usage.total_tokens"), F.lit(0)) * price_per_token).alias("cost"),
        F.avg(F.when(F.col("error_info").isNotNull(), 1.0).otherwise(0.0)).alias("error_rate"))


def spans_by_model(traces: DataFrame, step: int, by: list[str] = ()) -> DataFrame:
    """Calls per time bucket and model: ``(t, by.., model, spans)``; a trace without a model counts under ''."""
    t = (F.floor(micros("start_time") / (step * 1_000_000)) * step).cast("bigint").alias("t")
    return traces.groupBy(t, *by, F.coalesce(F.col("input.model"), F.lit("")).alias("model")).agg(F.count(F.lit(1)).alias("spans"))


def heuristic_vs_judge(scores: DataFrame, heuristic: str = "hallucination_quality",
                       judged: str = "hallucination_free") -> DataFrame:
    """Both scores side by side per trace and their difference."""
    w = scores.where(F.col("name").isin(heuristic, judged)).groupBy("id").agg(
        F.max(F.when(F.col("name") == heuristic, F.col("value"))).alias("heuristic"),
        F.max(F.when(F.col("name") == judged, F.col("value"))).alias("judged"))
    return w.where("heuristic is not null and judged is not null").withColumn(
        "difference", F.col("heuristic") - F.col("judged"))


def reconcile_traces(a: DataFrame, b: DataFrame, key: str, tolerance: float) -> DataFrame:
    """The same request traced by two paths: ``matched``, ``differs``, ``only_a``, ``only_b``.

    Each side has ``(key, tokens, duration)``.
    """
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    near = (F.col("a.tokens") == F.col("b.tokens")) & (F.abs(F.col("a.duration") - F.col("b.duration")) <= tolerance)
    status = (F.when(F.col(f"b.{key}").isNull(), "only_a").when(F.col(f"a.{key}").isNull(), "only_b")
              .when(near, "matched").otherwise("differs"))
    return j.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), status.alias("status"),
                    (F.col("a.tokens") - F.col("b.tokens")).alias("token_diff"),
                    (F.col("a.duration") - F.col("b.duration")).alias("duration_diff"))


def judge_batch(scorer: Callable[[list[str]], list[str]]):
    """Wrap a scorer (prompts -> replies) for ``mapInPandas`` over ``(id, prompt)``."""
    def run(batches):
        for b in batches:
            yield b[["id"]].assign(reply=scorer(b["prompt"].tolist()))

    return run


def judge_once(traces: DataFrame, scores: DataFrame | None, scorer: Callable[[list[str]], list[str]],
               project: str, reason: str, limit: int | None = None) -> DataFrame:
    """Pending traces -> prompts -> scorer -> score rows, as one plan.

    ``limit`` keeps the newest traces of a pass, ordered by start time.
    """
    t = traces if limit is None else traces.orderBy(F.desc("start_time"), "id").limit(limit)
    p = pending_traces(t, scores)
    prompts = p.select("id", judge_prompt(F.col("question"), F.col("answer")).alias("prompt"))
    return score_rows(prompts.mapInPandas(judge_batch(scorer), "id string, reply string"), project, reason)

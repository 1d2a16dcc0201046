"""Column functions over token log-probabilities.

Input is ``ARRAY<STRUCT<token, logprob, top_logprobs ARRAY<STRUCT<token, logprob>>>>``
with logprob as DOUBLE, or as STRING straight from JSON (then values that are
not numbers are skipped).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability floor, candidates used for the margin, threshold.
EPS = 1e-12
MARGIN_CANDIDATES = 8
LOW_CONFIDENCE = 0.5

LOGPROBS_SCHEMA = ("STRUCT<content: ARRAY<STRUCT<token: STRING, logprob: STRING, "
                   "top_logprobs: ARRAY<STRUCT<token: STRING, logprob: STRING>>>>>")


def _num(c: Column) -> Column:
    return c.try_cast("double")


def _mean(values: Column) -> Column:
    """Arithmetic mean of an array, null when empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def token_probs(content: Column) -> Column:
    """Probability of each sampled token; unusable entries are skipped."""
    return F.filter(F.transform(content, lambda e: F.exp(_num(e["logprob"]))), lambda p: p.isNotNull())


def perplexity(probs: Column) -> Column:
    """exp(-mean(ln p)); 0 means nothing was scored."""
    logs = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(EPS))))
    return F.coalesce(F.exp(-_mean(logs)), F.lit(0.0))


def confidence_mean(probs: Column) -> Column:
    return F.coalesce(_mean(probs), F.lit(0.0))


def confidence_std(probs: Column) -> Column:
    """Sample standard deviation, 0 for fewer than two tokens."""
    n = F.size(probs)
    mean = _mean(probs)
    # the mean is carried in the accumulator so it is folded once
    dev = F.aggregate(probs, F.struct(mean.alias("m"), F.lit(0.0).alias("s")),
                      lambda a, p: F.struct(a["m"].alias("m"), (a["s"] + (p - a["m"]) * (p - a["m"])).alias("s")),
                      lambda a: a["s"])
    return F.when(n < 2, 0.0).otherwise(F.sqrt(F.try_divide(dev, (n - 1).cast("double"))))


def confidence_min(probs: Column) -> Column:
    return F.coalesce(F.array_min(probs), F.lit(0.0))


def _entropy_of(top: Column) -> Column:
    """Entropy in nats over the returned candidates, null if they carry no mass."""
    probs = F.filter(F.transform(top, lambda c: F.exp(_num(c["logprob"]))), lambda p: p.isNotNull())
    mass = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)

    def add(acc, p):
        q = p / acc["m"]
        return F.struct(acc["m"].alias("m"),
                        (acc["h"] - F.when(q > EPS, q * F.log(q)).otherwise(0.0)).alias("h"))

    return F.when(mass > 0, F.aggregate(probs, F.struct(mass.alias("m"), F.lit(0.0).alias("h")), add,
                                        lambda a: a["h"]))


def token_entropy(content: Column) -> Column:
    """Mean entropy over tokens that carry candidates; a lower bound, 0 if none do."""
    scored = F.filter(content, lambda e: e["logprob"].isNotNull())
    per = F.filter(F.transform(scored, lambda e: _entropy_of(e["top_logprobs"])), lambda h: h.isNotNull())
    return F.coalesce(_mean(per), F.lit(0.0))


def _margin_of(top: Column) -> Column:
    first = F.filter(F.slice(top, 1, MARGIN_CANDIDATES), lambda c: c["logprob"].isNotNull())
    probs = F.reverse(F.sort_array(F.transform(first, lambda c: F.exp(_num(c["logprob"])))))
    broken = F.exists(first, lambda c: _num(c["logprob"]).isNull())
    return F.when((F.size(top) >= 2) & ~broken & (F.size(first) >= 2),
                  F.greatest(F.lit(0.0), F.element_at(probs, 1) - F.try_element_at(probs, F.lit(2))))


def top2_margin(content: Column) -> Column:
    """Mean gap between the two best candidates; 0 if no token has two."""
    scored = F.filter(content, lambda e: e["logprob"].isNotNull())
    per = F.filter(F.transform(scored, lambda e: _margin_of(e["top_logprobs"])), lambda m: m.isNotNull())
    return F.coalesce(_mean(per), F.lit(0.0))


def low_confidence_ratio(probs: Column, threshold: float = LOW_CONFIDENCE) -> Column:
    low = F.size(F.filter(probs, lambda p: p < threshold)).cast("double")
    return F.coalesce(F.try_divide(low, F.size(probs).cast("double")), F.lit(0.0))

"""Op 7: quality rules as a learned decision list.

Text statistics are column expressions.  Rules that reject are learned by
sequential covering from labelled rows: a rule grows by the threshold test with
the best information gain, is pruned back on rows held out from growing, and is
kept only while it stays precise; rows it covers leave, and the next is
learned.  All counting is done by Spark over a table of binned statistics, one
row per combination of bins, so a step of learning costs one small aggregate.
The list is emitted as an ordered conditional expression.

Defined cases: a null or empty text has no words and fails the base test; a
label that is null or belongs to no document teaches nothing; equal rows count each; without
labels the list is empty and only the base test rejects; other columns of the
input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, saved, text_or_empty

#: Thresholds tried for every statistic: quantiles of the labelled rows.
CUTS = 16
MOST_RULES = 12
MOST_TESTS = 4
#: Least precision, on either part of the labelled rows, at which a rule may reject.
PRECISE = 0.9

FEATURES = ("word_length", "symbols_per_word", "dup_line_share", "repeat_share", "marks_per_word", "upper_share", "digit_share", "distinct_share")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Window hashes are sorted with their places; equal neighbours are repeats.
    A repeat at place p covers three words, less what the next one covers.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))
    places = let(F.sort_array(windows), lambda s: F.filter(F.transform(s, lambda x, j: F.when(
        ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()))
    covered = let(F.sort_array(places), lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    # Most texts have no repeat at all: a set of hashes tells.
    plain = F.transform(windows, lambda w: w["h"])
    return F.when(n < 3, F.lit(0)).otherwise(F.when(F.size(F.array_distinct(plain)) == n - 2, F.lit(0)).otherwise(covered))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the counts of each text: a row per row of ``docs``, without a shuffle."""
    text = text_or_empty()
    words = F.array_remove(F.split(text, SPACE), "")
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    split = docs.select(*keep, text.alias("_text"), words.alias("_words"), F.filter(F.split(text, "\n"), has_word).alias("_lines"))
    return split.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("_words"), _repeat_words).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"))


def ratios(rows: DataFrame) -> DataFrame:
    """The features that rules test, added to :func:`statistics`."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return rows.withColumns({
        "word_length": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words,
        "marks_per_word": F.col("n_marks") / words, "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars, "distinct_share": F.col("n_distinct") / words})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """``feature`` at least (or below) ``bound``; ``cut`` is the bound's number."""

    feature: str
    above: bool
    cut: int
    bound: float

    def holds(self) -> Column:
        return F.col(self.feature) >= self.bound if self.above else F.col(self.feature) < self.bound

    def binned(self) -> Column:
        bin_ = F.col(f"b_{self.feature}")
        return bin_ > self.cut if self.above else bin_ <= self.cut


def _all(tests, how) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & how(t)
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """FOIL's information gain of going from p0/n0 to p/n bad and good rows."""
    from math import log2
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, features=FEATURES) -> list[list[Test]]:
    """An ordered list of conjunctions that reject.

    ``labelled`` has the features, ``bad`` (boolean) and ``fold`` (0 or 1 to grow, 2 to prune).
    Only counts reach the driver: a few numbers for each candidate test.
    """
    grid = labelled.agg(*[F.percentile_approx(f, [(i + 1) / (CUTS + 1) for i in range(CUTS)], 1000).alias(f) for f in features],
                        *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), [(i + 1) / (CUTS + 1) for i in range(CUTS)], 1000).alias(f"bad_{f}") for f in features]).first()
    bounds = {f: sorted({*(grid[f] or []), *(grid[f"bad_{f}"] or [])}) for f in features}
    binned = labelled.select("bad", (F.col("fold") == 2).alias("prune"), *[
        sum([(F.col(f) >= b).cast("int") for b in bounds[f]], F.lit(0)).alias(f"b_{f}") for f in features])
    # A bin number above i means a value of at least the i-th bound (from 0).
    table = saved(binned.groupBy(*binned.columns).count(), "rule-bins")
    tests = [Test(f, above, i, b) for f in features for i, b in enumerate(bounds[f]) for above in (True, False)]

    def counts(rows: DataFrame, conditions: list[Column]) -> list[tuple[int, int]]:
        sums = [F.sum(F.when(c & F.col("bad") if bad else c & ~F.col("bad"), F.col("count"))) for c in conditions for bad in (True, False)]
        got = [x or 0 for x in rows.agg(F.array(*sums).alias("a")).first()["a"]]
        return list(zip(got[::2], got[1::2], strict=True))

    def every_test(rows: DataFrame) -> list[tuple[int, int]]:
        """Bad and good rows of each test, from one histogram per feature (features x bins rows)."""
        bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in features])).alias("x")
        got = rows.select(bins, "bad", "count").groupBy("x.f", "x.b", "bad").agg(F.sum("count").alias("n")).collect()
        out = []
        for t in tests:
            mine = [r for r in got if r["f"] == t.feature and (r["b"] > t.cut) == t.above]
            out.append((sum(r["n"] for r in mine if r["bad"]), sum(r["n"] for r in mine if not r["bad"])))
        return out

    rules: list[list[Test]] = []
    left = table
    while len(rules) < MOST_RULES:
        rule: list[Test] = []
        grow, prune = left.where(~F.col("prune")), left.where("prune")
        (p0, n0), = counts(grow, [F.lit(True)])
        total = p0
        while len(rule) < MOST_TESTS and p0 and n0:
            got = every_test(grow.where(_all(rule, Test.binned)))
            best, (p, n) = max(zip(tests, got, strict=True), key=lambda x: _gain(p0, n0, *x[1]))
            if _gain(p0, n0, p, n) <= 0:
                break
            rule.append(best)
            p0, n0 = p, n
        if not rule or not total:
            break
        # Drop tests from the end while the held out rows don't speak for them.
        shapes = [rule[:k] for k in range(1, len(rule) + 1)]
        held = counts(prune, [_all(s, Test.binned) for s in shapes])
        worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(held)]
        k = max(range(len(shapes)), key=lambda i: worth[i])
        rule = shapes[k]
        (gp, gn), = counts(grow, [_all(rule, Test.binned)])
        hp, hn = held[k]
        if gp < PRECISE * (gp + gn) or hp + hn and hp < PRECISE * (hp + hn) or gp + hp < 3:
            break
        rules.append(rule)
        left = left.where(~_all(rule, Test.binned))
    return rules


def decision(rules: list[list[Test]]) -> Column:
    """Number of the first rule that applies, from 1; 0 if none."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule, Test.holds), F.lit(k)).otherwise(out)
    return out


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of labelled rows that pass the base test, with ``bad`` and ``fold``."""
    marks = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    return (rows.where(~base_failed()).join(marks, "doc_id")
            .withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3))))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (0: none) and kept, for every row of ``docs``."""
    rows = ratios(saved(statistics(docs, "doc_id"), "quality"))
    rules = learn(labelled_rows(rows, labels))
    return rows.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, columns as given.

    Rules are learned from statistics of the labelled rows; the filter itself
    is one pass over the texts without a shuffle.
    """
    rules = learn(labelled_rows(ratios(saved(statistics(docs, "doc_id"), "quality")), labels))
    whole = F.struct(*[docs[c] for c in docs.columns])
    rows = ratios(statistics(docs.select(whole.alias("_row"), "text"), "_row"))
    return rows.where(~base_failed() & (decision(rules) == 0)).select("_row.*")

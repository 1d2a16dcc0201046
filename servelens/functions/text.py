"""Column functions that score completion text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and weights of the text heuristics.
STOPWORDS = (
    "a an and are as at be but by for from has have in is it its of on or "
    "that the this to was were will with you i he she they we"
).split()
HEDGES = (
    "maybe", "perhaps", "i think", "i believe", "probably", "roughly",
    "approximately", "i guess", "it seems", "likely", "possibly",
)
REFUSAL = (
    r"\b(i (can'?t|cannot|do not know|don'?t know|am not able|am unable|don'?t have access|couldn'?t find)"
    r"|no information|not possible for me to)\b"
)
STRIPPED = ".,!?;:()\"'"
MIN_WORDS = 9
WEIGHTS = {"repetition": 0.5, "refusal": 0.25, "hedging": 0.4, "ungrounded": 0.7}
FLAG_ABOVE = 0.5
# What counts as white space when a text is split into words.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(text: Column) -> Column:
    """White-space separated words of the whole text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0)).cast("bigint")


def strip(text: Column) -> Column:
    """Trim white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (Column -> Column)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def content_words(text: Column) -> Column:
    """Lower-cased words without edge punctuation and stop words."""
    bare = F.transform(F.split(F.lower(text), SPACE + "+"), lambda w: F.btrim(w, F.lit(STRIPPED)))
    return F.filter(bare, lambda w: ~w.isin("", *STOPWORDS))


def repetition(text: Column) -> Column:
    """Share of the most frequent word trigram; 0 below nine content words.

    Stays inside the row: trigrams are sorted and the longest run of equals is
    folded out, so nothing is exploded or shuffled.
    """
    def grams(w):
        # a word holds no white space, so a blank joins words without ambiguity
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(
            " ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    return let(content_words(F.coalesce(text, F.lit(""))), lambda w: F.when(
        F.size(w) >= MIN_WORDS, _top_share(F.sort_array(grams(w)))).otherwise(F.lit(0.0)))


def _top_share(ordered: Column) -> Column:
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("n"))

    def step(acc, g):
        run = F.when(g == acc["last"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"),
                        (acc["n"] + 1).alias("n"))

    return F.aggregate(ordered, zero, step, lambda a: F.coalesce(
        F.try_divide(a["best"].cast("double"), a["n"].cast("double")), F.lit(0.0)))


def refusal(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike("(?iU)" + REFUSAL), 1.0).otherwise(0.0)


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")


def hedging(text: Column) -> Column:
    """Hedge phrases (substring counts) over five, at most 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = sum((occurrences(low, p) for p in HEDGES[1:]), occurrences(low, HEDGES[0]))
    return F.least(total / F.lit(5.0), F.lit(1.0))


def ungrounded(text: Column, tools_offered: Column, tool_calls: Column) -> Column:
    """1 if tools were offered, none was called and the answer has a digit."""
    hit = tools_offered & (tool_calls <= 0) & F.coalesce(text, F.lit("")).rlike(r"(?U)\d")
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def composite_risk(rep: Column, ref: Column, hed: Column, ung: Column) -> Column:
    w = WEIGHTS
    return F.least(F.lit(1.0), w["repetition"] * rep + w["refusal"] * ref + w["hedging"] * hed
                   + w["ungrounded"] * ung)


def flagged(risk: Column) -> Column:
    return risk > FLAG_ABOVE

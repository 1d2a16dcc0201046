"""Op 10: preference formatting.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns is rendered once as the prompt; the rest of either side is its completion, with a
mask that trains on the assistant's words only.

Defined cases: a null role renders as an empty one; a null text as none; turns with
the same number are ordered by role and text; a missing side has no turns, so nothing is
common and its completion is empty; equal sides have an empty completion each; an
empty table gives no pairs; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def _rendered(t: Column) -> Column:
    return F.concat(_head(t), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _mask(turns: Column) -> Column:
    """Spans (start, length), in characters of the completion, that are trained on: an assistant's text and its end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        whole, head = F.length(_rendered(t)), F.length(_head(t))
        span = F.struct((acc["at"] + head).alias("start"), (whole - head - 1).alias("length"))
        return F.struct((acc["at"] + whole).alias("at"),
                        F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """A row per pair.

    ``turns``: pair_id, chosen (boolean: the side), turn, role, text.  One conversation is gathered in a row, as
    the rendered text is; nothing else is.
    """
    one = F.struct("turn", "role", "text")
    sides = turns.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("chosen"), one))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("chosen"), one))).alias("r"))
    # zip_with pads the shorter side with nulls, which equal no turn.
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(F.col("same"), F.lit(False)).cast("int")
    split = (sides.withColumn("same", same).withColumn("common", F.when(first == 0, F.size("same")).otherwise(first - 1))
             .select("pair_id", "common", F.slice("c", F.lit(1), F.col("common")).alias("p"),
                     *[F.filter(s, lambda _, i: i >= F.col("common")).alias(s) for s in ("c", "r")]))
    text = lambda s: F.array_join(F.transform(s, _rendered), "")
    return split.select("pair_id", F.col("common").alias("n_prompt_turns"), F.size("c").alias("n_chosen_turns"), F.size("r").alias("n_rejected_turns"),
                        text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"),
                        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def pairs_from_replies(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs out of plain conversations.

    The chosen side is the conversation up to its last assistant turn.  The
    rejected side has, in that place, the last assistant turn of the
    conversation whose id differs in the lowest bit, and lacks the turn if
    there is none.  Conversations without an assistant turn or an id form no pair.
    """
    known = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    last = known.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    turns = known.join(last, "conv_id").where((F.col("turn") <= F.col("last.turn")) | F.col("turn").isNull())
    answer = F.col("turn").eqNullSafe(F.col("last.turn")) & F.col("role").eqNullSafe(F.lit(TRAINED)) & F.col("text").eqNullSafe(F.col("last.text"))
    out = ["pair_id", "chosen", "turn", "role", "text"]
    chosen = turns.withColumnsRenamed({"conv_id": "pair_id"}).withColumn("chosen", F.lit(True)).select(out)
    kept = turns.where(~answer).withColumnsRenamed({"conv_id": "pair_id"}).withColumn("chosen", F.lit(False)).select(out)
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("text"))
    swapped = last.join(other, "conv_id").select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("chosen"), "last.turn", F.lit(TRAINED).alias("role"), "text")
    return chosen.unionByName(kept).unionByName(swapped)

"""Links and connected groups out of buckets of candidates, without emitting all pairs of a bucket.

1. Every member of a bucket is tested against one leader of the bucket: the member that shares most
   buckets with most others, which among variants of a text is the text they vary.  A member's most
   frequent leader comes first, the others only where they aren't connected yet.
2. Confirmed links are contracted.  Only buckets that still hold members of
   different groups are looked at again: each member outside the bucket's largest
   group is tested against every member of other groups.  That is exact: afterwards every pair that
   shares a bucket is connected or was tested.  An operator that can rule out pairs from what
   leaders have shown passes ``within`` and is asked for the pairs instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating star contraction: neighbours are joined to the smallest
    neighbour, never gathered; the number of rounds grows with the logarithm of the longest chain.
    """
    pair = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        pair = saved(small, "edges")
        now = tuple(pair.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return pair.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pair.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def rooted(rows: DataFrame, roots: DataFrame | None, node: str, root: str) -> DataFrame:
    """``rows`` with the group of the node in column ``node``, itself if it has no link, as column ``root``."""
    if roots is None:
        return rows.withColumn(root, F.col(node))
    names = roots.select(F.col("node").alias(f"_{node}"), F.col("root").alias(f"_{root}"))
    return rows.join(names, F.col(node) == F.col(f"_{node}"), "left").withColumn(root, F.coalesce(f"_{root}", node)).drop(f"_{node}", f"_{root}")


def linked(buckets: DataFrame, fetch: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame], DataFrame],
           within: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame] | None = None,
           may: Callable[[Column, Column], Column] | None = None) -> DataFrame | None:
    """(node, root) of all nodes with a link, or None without links.

    ``buckets``: (bucket long, node long), one row per membership, cheap to read again.  ``fetch``
    takes the nodes that share a bucket and returns (node, payload struct); ``confirm`` takes
    distinct pairs (a, b, pa, pb) with both payloads and returns the (a, b) that are links.
    ``within`` takes (node, leader), the payloads and the groups so far, and returns the pairs (a, b), a < b, of
    different groups that can still be links.  ``may`` says of the column ``mark`` of two rows of ``buckets``
    whether their nodes can be a link; what can't is no pair.
    """
    marks = [] if may is None else ["mark"]
    size = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(buckets.join(size, "bucket"), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    heaviest = F.max_by(F.struct(F.col("node").alias("leader"), *[F.col(c).alias(f"lead_{c}") for c in marks]), F.struct("weight", F.xxhash64("node"), "node"))
    lead = members.join(weight, "node").groupBy("bucket").agg(heaviest.alias("l")).select("bucket", "l.*")
    shared = saved(members.select("bucket", "node", *marks).join(lead, "bucket"), "buckets")
    payload = saved(fetch(shared.select("node").distinct()).select("node", "payload"), "payloads")
    other = shared.where("node <> leader")
    if may is not None:
        other = other.where(may(F.col("mark"), F.col("lead_mark")))
    asked = saved(other.groupBy("node", "leader").agg(F.count("*").alias("n"))
                  .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), "node", "n"), "leaders")
    links, roots, tested = None, None, None
    for turn in ("best", "others", "within"):
        if turn == "best":
            pairs = asked.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("n", "a", "b")).alias("p")).select("p.*").distinct()
        elif turn == "others":
            pairs = rooted(rooted(asked.select("a", "b").distinct(), roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b")
        elif within is not None:
            pairs = within(asked.select("node", F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("leader")), payload, roots)
        else:
            pairs = across(shared, roots, may)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs, f"pairs-{turn}")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        both = (pairs.join(payload.select(F.col("node").alias("a"), F.col("payload").alias("pa")), "a")
                .join(payload.select(F.col("node").alias("b"), F.col("payload").alias("pb")), "b"))
        found = saved(confirm(both).select("a", "b"), f"links-{turn}")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        roots = saved(components(links), f"roots-{turn}")
    return roots


def across(shared: DataFrame, roots: DataFrame | None, may: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs (a, b) of different groups that share a bucket; one of the two is outside the bucket's largest group."""
    marks = [] if may is None else ["mark"]
    placed = saved(rooted(shared.select("bucket", "node", *marks), roots, "node", "root"), "placed")
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = groups.groupBy("bucket").agg(F.count("*").alias("groups"), F.max_by("root", F.struct("n", "root")).alias("largest")).where("groups > 1")
    open_ = placed.join(mixed.select("bucket", "largest"), "bucket")
    x = open_.where("root <> largest").select("bucket", F.col("node").alias("x"), F.col("root").alias("rx"), *[F.col(c).alias("mx") for c in marks])
    y = open_.select("bucket", F.col("node").alias("y"), F.col("root").alias("ry"), "largest", *[F.col(c).alias("my") for c in marks])
    pairs = x.join(y, "bucket").where("rx <> ry AND (ry = largest OR x < y)")
    if may is not None:
        pairs = pairs.where(may(F.col("mx"), F.col("my")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

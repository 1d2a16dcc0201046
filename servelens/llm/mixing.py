"""Op 8: mixing sources to target weights by pivotal dependent rounding.

A document of a source with target ``t`` and size ``s`` is wanted ``t / s``
times.  The whole part is taken outright; the fraction is rounded so that, pair
by pair, word mass moves from one document to the other until one of the two is
integral.  Each move keeps the pair's expected words, and each document's
expected copies, exact.  Blocks of a few dozen documents are rounded at a time;
what is left of each (at most one document) goes to the next level, until one
document per source is left, which goes to the nearer whole number.  A move makes the smaller of two documents
integral first, so that last one may be large; the words by which it misses the target are
made up by :func:`_settled`, which sends a few of the source's rounded documents, from large to small, to
their other neighbouring whole number.  What then misses is less than the smallest documents it had to choose from.

Defined cases: a null or empty text has size 0 and takes nothing; a null
source is a source of its own, last; rows equal in id, source and text are
told apart by number; all draws come from hashes of the values, so reruns agree;
an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, text_or_empty, unit_interval

BLOCK = 48
#: Documents of a size class that may settle what a source misses.
CHOICE = 4
MOST = 3
KEY = ("source", "doc_id", "crc", "size")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a checksum of the text."""
    text = text_or_empty()
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.crc32(text.cast("binary")).alias("crc"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def source_targets(rows: DataFrame, weights: Column | None = None) -> DataFrame:
    """source, source_size, target: a row per source (pre-aggregated, so the one global order is over sources).

    With targets ``min(3 * size, level * weight)`` the level is found in closed
    form: the sources with the least size per weight are the full ones.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.col("rank") % 3 + 1 if weights is None else weights
    per = per.withColumn("rank", rank).withColumn("weight", weight.cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    every = Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.lit(MOST) * F.coalesce(F.sum("source_size").over(upto), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(every) - full) / left)
    # The first source, in this order, that isn't full sets the level for all after it.
    fits = F.col("level") * F.col("weight") <= MOST * F.col("source_size")
    level = F.min(F.when(fits, F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("rank"), F.col("level")))).over(every)["level"]
    return per.withColumn("common", level).select(
        "source", "source_size",
        F.coalesce(F.least(F.lit(MOST) * F.col("source_size").cast("double"), F.col("common") * F.col("weight")), F.lit(0.0)).alias("target"), "n")


def _transfer(held: Column, new: Column, draw: Column):
    """(kept fraction, moved on fraction) of ``held`` and ``new`` after one move of word mass."""
    a, b, ratio = held["x"], new["x"], new["size"] / held["size"]
    up = F.least(1 - a, b * ratio)
    down = F.least(a, (1 - b) * ratio)
    rise = draw * (up + down) < down
    x = F.when(rise, F.when(1 - a <= b * ratio, F.lit(1.0)).otherwise(a + up)).otherwise(F.when(a <= (1 - b) * ratio, F.lit(0.0)).otherwise(a - down))
    y = F.when(rise, F.when(b * ratio <= 1 - a, F.lit(0.0)).otherwise(b - up / ratio)).otherwise(
        F.when((1 - b) * ratio <= a, F.lit(1.0)).otherwise(b + down / ratio))
    return x, y


_UNIT = "struct<doc_id:{0},crc:bigint,size:bigint,nth:int,base:int,x:double,u:double>"


def _fraction(unit: Column) -> Column:
    return (unit["x"] > 0) & (unit["x"] < 1)


def _with_x(unit: Column, x: Column) -> Column:
    return F.struct(*[unit[c].alias(c) for c in ("doc_id", "crc", "size", "nth", "base")], x.alias("x"), unit["u"].alias("u"))


def _round_block(units: Column, kind: str) -> Column:
    """struct(held: the fractional unit that is left or null, done: the integral ones)."""
    start = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast(f"array<{kind}>").alias("done"))

    def step(acc, new):
        x, y = _transfer(acc["held"], new, new["u"])
        moved = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda m: F.array(_with_x(acc["held"], m["x"]), _with_x(new, m["y"]))).getItem(0)
        pair = F.when(acc["held"].isNull() | ~_fraction(new), F.filter(F.array(acc["held"], new), lambda q: q.isNotNull())).otherwise(moved)
        return F.transform(F.array(pair), lambda p: F.struct(
            F.get(F.filter(p, _fraction), F.lit(0)).alias("held"), F.concat(acc["done"], F.filter(p, lambda q: ~_fraction(q))).alias("done"))).getItem(0)

    return F.aggregate(units, start, step)


def copies(rows: DataFrame, targets: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, source, crc, size, nth (number among equal rows), copies.

    ``rows`` must be cheap to read again (see :func:`common.saved`).
    """
    kind = _UNIT.format(dict(rows.dtypes)["doc_id"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    alike = Window.partitionBy(*KEY).orderBy("size")
    counted = F.col("size") > 0  # an empty document weighs nothing and is taken once
    want = (rows.withColumn("nth", F.row_number().over(alike))
            .join(targets.select(F.col("source").alias("s"), "source_size", "target", "n"), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("base", F.when(counted, F.floor(ratio).cast("int")).otherwise(1)).withColumn("x", F.when(counted, ratio - F.floor(ratio)).otherwise(F.lit(0.0))))
    todo = saved(want.select("source", "n", F.struct("doc_id", "crc", "size", "nth", "base", "x", F.lit(0.0).alias("u")).cast(kind).alias("unit")), "mix-units")
    most, level, rounded = targets.agg(F.max("n")).first()[0] or 0, 0, None
    while most:
        who = [F.col(f"unit.{c}") for c in ("doc_id", "crc", "size", "nth")]
        # A level cuts a source into blocks and leaves at most one unit of each.
        cuts = F.ceil(F.col("n") / block)
        drawn = F.col("unit").withField("u", unit_interval(*who, F.lit(f"{seed} draw {level}")))
        packed = (todo.groupBy("source", cuts.alias("n"), F.pmod(F.xxhash64(*who, F.lit(f"{seed} cut {level}")), cuts).alias("cut"))
                  .agg(F.sort_array(F.collect_list(F.struct((-F.col("unit.size")).alias("o"), F.xxhash64(*who, F.lit(f"{seed} order {level}")).alias("h"), drawn.alias("unit")))).alias("units"))
                  .select("source", "n", _round_block(F.transform("units", lambda z: z["unit"]), kind).alias("r")))
        packed = saved(packed, f"mix-level{level}")
        done = packed.select("source", F.explode("r.done").alias("unit"))
        rounded = done if rounded is None else rounded.unionByName(done)
        todo = packed.where("r.held is not null").select("source", "n", F.col("r.held").alias("unit"))
        level, most = level + 1, -(-most // block)
        if most == 1:
            x = (F.col("unit.x") >= 0.5).cast("double")  # the nearer one, for the sake of the target
            rounded = rounded.unionByName(todo.select("source", _with_x(F.col("unit"), x).cast(kind).alias("unit")))
            break
    if rounded is None:
        rounded = todo
    done = rounded.select("source", "unit.doc_id", "unit.crc", "unit.size", "unit.nth", F.col("unit.base").cast("long").alias("base"),
                          (F.col("unit.base") + F.col("unit.x").cast("int")).cast("long").alias("copies"))
    return _settled(saved(done, "mix-rounded"), targets, seed)


def _settled(done: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Copies after a source's missing or surplus words went to some of its documents.

    Of each source, size class (a power of two) and direction, at most ``CHOICE`` documents are looked at, so
    a source's list is bounded.  From large to small, one moves whenever that brings the source nearer to its target,
    at first or after one of them overshot; the nearest end counts.  Copies stay the whole number below or above the wanted fraction.
    """
    who = ["source", "doc_id", "crc", "size", "nth"]
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = targets.select(F.col("source").alias("s"), "target", (ratio > F.floor(ratio)).alias("between"))
    mass = done.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    mass = mass.where("between").select(F.col("source").alias("s"), (F.col("target") - F.col("taken")).alias("missing"))
    order = F.xxhash64(*who, F.lit(f"{seed} settle"))
    one = F.struct((-F.col("size")).alias("o"), order.alias("h"), F.when(F.col("copies") > F.col("base"), -1).otherwise(1).alias("move"), F.struct(*who).alias("who"))
    few = (done.where("size > 0").groupBy("source", F.floor(F.log2("size")).alias("class"), (F.col("copies") > F.col("base")).alias("up"), F.pmod(order, F.lit(CHOICE)).alias("k"))
           .agg(F.min(one).alias("c")).select("source", F.col("c").withField("first", F.col("k") == 0).alias("c")).groupBy("source").agg(F.sort_array(F.collect_list("c")).alias("c")))
    # The state's list holds the moves made; a document's words are -o.
    who_kind = few.schema["c"].dataType.elementType["who"].dataType.simpleString()
    kind = f"struct<missing:double,moves:array<struct<move:int,who:{who_kind}>>>"

    def moved(state, c):
        return F.struct((state["missing"] + c["o"] * c["move"]).alias("missing"), F.concat(state["moves"], F.array(F.struct(c["move"].alias("move"), c["who"].alias("who")))).alias("moves")).cast(kind)

    def greedy(state, but):
        def step(have, c):
            nearer = F.abs(have["missing"] + c["o"] * c["move"]) < F.abs(have["missing"])
            return F.when(nearer & (but.isNull() | (c["who"] != but["who"])), moved(have, c)).otherwise(have)
        return F.aggregate("c", state, step)

    start = F.struct(F.col("missing").cast("double").alias("missing"), F.array().alias("moves")).cast(kind)
    # Also tried: one move, of each class and direction, that overshoots first.
    tries = F.concat(F.array(greedy(start, F.lit(None).cast(f"struct<who:{who_kind}>"))),
                     F.transform(F.filter("c", lambda c: c["first"]), lambda c: greedy(moved(start, c), c)))
    best = F.array_min(F.transform(tries, lambda t: F.struct(F.abs(t["missing"]).alias("off"), F.size(t["moves"]).alias("n"), t["moves"].alias("moves"))))
    moves = few.join(mass, F.col("source").eqNullSafe(F.col("s"))).select(F.explode(best["moves"]).alias("m")).select("m.who", "m.move")
    out = done.withColumn("who", F.struct(*who)).join(moves, "who", "left")
    return out.select(*who, (F.col("copies") + F.coalesce("move", F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), source, copies of every document."""
    rows = saved(sized(docs), "mix-sizes")
    targets = saved(source_targets(rows), "mix-targets")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (copies(rows, targets, seed).join(t, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                    (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as given."""
    rows = saved(sized(docs), "mix-sizes")
    want = copies(rows, saved(source_targets(rows), "mix-targets"), seed).select(*[F.col(c).alias(f"_mix_{c}") for c in (*KEY, "nth", "copies")])
    text = text_or_empty()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row"), F.col("source").cast("string").alias("_k_source"), F.col("doc_id").alias("_k_doc_id"),
                        F.crc32(text.cast("binary")).alias("_k_crc"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_k_size"))
    # Rows equal in the key are interchangeable: the n-th of them gets the n-th count.
    keyed = keyed.withColumn("_k_nth", F.row_number().over(Window.partitionBy(*[f"_k_{c}" for c in KEY]).orderBy("_k_size")))
    on = [F.col(f"_k_{c}").eqNullSafe(F.col(f"_mix_{c}")) for c in KEY] + [F.col("_k_nth") == F.col("_mix_nth")]
    out = keyed.join(want.where("_mix_copies > 0"), on)
    return out.select("_mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))).alias("_mix_copy")).select("_mix_row.*")

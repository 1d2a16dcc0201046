"""Label-matched algebra over vectors ``(t, <labels>, value)``."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import Grid

_FIXED = ("t", "value")


def labels_of(v: DataFrame) -> list[str]:
    return [c for c in v.columns if c not in _FIXED]


def _apply(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return F.try_divide(a, b)
    raise ValueError(f"unknown operator {op}")


def _test(op: str, a: Column, b: Column) -> Column:
    tests = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": a == b, "!=": a != b}
    return ~F.isnan(a) & ~F.isnan(b) & tests[op]


def scalar(v: DataFrame, op: str, x: float, swap: bool = False) -> DataFrame:
    """Vector-with-number arithmetic; ``swap`` puts the number on the left."""
    a, b = F.col("value"), F.lit(float(x))
    return v.withColumn("value", _apply(op, b, a) if swap else _apply(op, a, b))


def _aligned(left: DataFrame, right: DataFrame, on: list[str] | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides plus the match key.  Without ``on`` all labels must agree and a
    label that only one side has reads as '' on the other."""
    if on is not None:
        return left, right, ["t", *on]
    names = sorted(set(labels_of(left)) | set(labels_of(right)))
    left = left.withColumns({n: F.lit("") for n in names if n not in left.columns})
    right = right.withColumns({n: F.lit("") for n in names if n not in right.columns})
    return left, right, ["t", *names]


def _paired(left: DataFrame, right: DataFrame, on: list[str] | None) -> tuple[DataFrame, list[str]]:
    keep = left.columns
    l2, r2, key = _aligned(left, right, on)
    return l2.join(r2.select(*key, F.col("value").alias("_r")), key, "inner"), keep


def arith(left: DataFrame, op: str, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Vector-with-vector arithmetic on equal labels; keeps the left labels."""
    j, keep = _paired(left, right, on)
    return j.withColumn("value", _apply(op, F.col("value"), F.col("_r"))).select(*keep)


def cmp(left: DataFrame, op: str, right, on: list[str] | None = None) -> DataFrame:
    """Filtering comparison with a number or a vector; keeps the left value."""
    if not isinstance(right, DataFrame):
        return left.where(_test(op, F.col("value"), F.lit(float(right))))
    j, keep = _paired(left, right, on)
    return j.where(_test(op, F.col("value"), F.col("_r"))).select(*keep)


def clamp_min(v: DataFrame, x: float) -> DataFrame:
    """Lower bound; an undefined (null) value stays undefined."""
    return v.withColumn("value", F.when(F.col("value").isNotNull(), F.greatest("value", F.lit(float(x)))))



def agg_by(v: DataFrame, fn: str, by: list[str] = ()) -> DataFrame:
    """``sum | min | max | avg`` over series, per time and group."""
    f = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[fn]
    return v.groupBy("t", *by).agg(f("value").alias("value")).select("t", *by, "value")


def count_by(v: DataFrame, by: list[str] = ()) -> DataFrame:
    """Number of series per time and group."""
    return v.groupBy("t", *by).agg(F.count(F.lit(1)).cast("double").alias("value")).select("t", *by, "value")


def vec_and(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Left rows that have a partner on the right; ``on=[]`` matches on time only."""
    l2, r2, key = _aligned(left, right, on)
    return l2.join(r2.select(*key).distinct(), key, "left_semi").select(*left.columns)


def vec_unless(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Left rows without a partner on the right."""
    l2, r2, key = _aligned(left, right, on)
    return l2.join(r2.select(*key).distinct(), key, "left_anti").select(*left.columns)


def vec_or(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """All left rows plus the right rows that match none of them."""
    rest = vec_unless(right, left, on)
    names = sorted(set(labels_of(left)) | set(labels_of(rest)))

    def full(d):
        return d.withColumns({n: F.lit("") for n in names if n not in d.columns}).select("t", *names, "value")

    return full(left).unionByName(full(rest))


def first_of(*vectors: DataFrame, on: list[str] | None = None) -> DataFrame:
    """``a or b or c``."""
    return reduce(lambda a, b: vec_or(a, b, on), vectors)


def constant(spark, grid: Grid, x: float) -> DataFrame:
    """``vector(x)`` on the grid."""
    return grid.frame(spark).withColumn("value", F.lit(float(x)))


def offset(v: DataFrame, seconds: int) -> DataFrame:
    """Read the vector as it was ``seconds`` earlier.

    Evaluate the inner vector on a grid shifted back by the same amount; see
    :func:`shifted`.
    """
    return v.withColumn("t", F.col("t") + F.lit(seconds).cast("bigint"))


def shifted(grid: Grid, seconds: int) -> Grid:
    """The grid an ``offset`` operand has to be evaluated on."""
    return Grid(grid.start - seconds, grid.end - seconds, grid.step)


def info_join(v: DataFrame, info: DataFrame, on: list[str], copy: list[str]) -> DataFrame:
    """Many-to-one join that copies text labels of an info metric.

    Info metrics hold one row per entity; AQE broadcasts them when their
    measured size is small enough.
    """
    dim = info.groupBy(*on).agg(*[F.max(c).alias(c) for c in copy])
    return v.join(dim, on, "inner").select("t", *labels_of(v), *copy, "value")


def last_not_null(v: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Final non-null point of each series (panel reducer)."""
    keys = labels_of(v) if by is None else list(by)
    ok = v.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return ok.groupBy(*keys).agg(F.max("t").alias("t"), F.max_by("value", "t").alias("value"))


def share_of_total(v: DataFrame, floor: float = 1.0) -> DataFrame:
    """100 * value / max(total at the same time, floor)."""
    total = v.groupBy("t").agg(F.sum("value").alias("_total"))
    return (v.join(total, "t")
            .withColumn("value", 100.0 * F.col("value") / F.greatest("_total", F.lit(float(floor))))
            .select(*v.columns))


def sort_desc(v: DataFrame) -> DataFrame:
    """Rank series by value, highest first; ties by label."""
    return v.orderBy(F.desc("value"), *labels_of(v))


def series_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Label sets present in only one of two sample stores: ``(side, metric, series)``."""
    from .samples import normalise_labels

    def ids(d):
        return d.select("metric", normalise_labels(F.col("labels")).alias("series")).distinct()

    ia, ib = ids(a), ids(b)
    key = ["metric", "series"]
    return (ia.join(ib, key, "left_anti").select(F.lit("only_a").alias("side"), *key)
            .unionByName(ib.join(ia, key, "left_anti").select(F.lit("only_b").alias("side"), *key)))


def value_heatmap(samples: DataFrame, step: int, bins: int = 24, by: list[str] = ()) -> DataFrame:
    """Count of values per time bucket and value bin; bin bounds from the data.

    ``(t, by.., bin 0..bins-1, lower, n)`` where ``t`` is the start of the bucket.
    """
    ok = samples.where(~F.isnan("value"))
    # one-row scalar subquery, no join
    lim = ok.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("s")).scalar()
    d = ok.withColumn("_s", lim).withColumns({"_lo": F.col("_s.lo"), "_hi": F.col("_s.hi")})
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("value") - F.col("_lo"), width)),
                                  F.lit(bins - 1))).otherwise(0)
    return (d.groupBy((F.floor(F.unix_micros("ts") / (step * 1_000_000)) * step).cast("bigint").alias("t"), *by,
                      b.cast("int").alias("bin"), (F.col("_lo") + b * width).alias("lower"))
            .agg(F.count(F.lit(1)).alias("n")))

"""One roll-up of a samples table that feeds many rules and panels.

:func:`needs` runs expressions against a source that only notes what they read; :func:`roll_up` then reduces each of those
metrics once, in one job per kind of roll-up, and writes the result partitioned by metric.  Expressions
evaluated on the :class:`RolledUp` source prune to their metrics and never touch raw samples again, whatever their windows, offsets and labels.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import samples as S
from ..scratch import saved
from .source import Source

_KINDS = {"last": "t bigint, _n bigint, _last double", "sum": "t bigint, _band int, _n bigint, _units decimal(38,0)",
          "counter": "t bigint, _band int, _n bigint, _units decimal(38,0)"}


@dataclass(frozen=True)
class Noted(Source):
    """Reads nothing; ``seen`` collects (kind, full metric name)."""

    seen: set = field(default_factory=set, hash=False)

    def rollup(self, kind, metric, labels=(), eq=None, re=None, raw=False):
        self.seen.add((kind, metric if raw else self.naming.m(metric)))
        columns = "".join(f"`{n}` string, " for n in labels)
        return self.samples.sparkSession.createDataFrame([], f"{S.SERIES} string, {columns}{_KINDS[kind]}")


def needs(source: Source, expressions: Iterable[Callable[[Source], DataFrame]]) -> set[tuple[str, str]]:
    """(kind, metric) of all that the expressions read."""
    noted = Noted(source.samples, source.grid, source.naming, source.lookback, source.res)
    for read in expressions:
        read(noted)
    return noted.seen


@dataclass(frozen=True)
class RolledUp(Source):
    """A source over written roll-ups: ``tables`` maps a kind to rows (metric, series, t, ..)."""

    tables: dict = field(default_factory=dict, hash=False)

    def rollup(self, kind, metric, labels=(), eq=None, re=None, raw=False):
        d = self.tables[kind].where(F.col("metric") == (metric if raw else self.naming.m(metric)))
        d = d.withColumn("_labels", F.from_json(S.SERIES, "map<string,string>"))
        d = d.where(S.matcher(F.col("_labels"), eq, re))
        own = [c.split()[0] for c in _KINDS[kind].split(", ")]
        return d.select(S.SERIES, *[F.coalesce(F.col("_labels")[n], F.lit("")).alias(n) for n in labels], *own)


def roll_up(source: Source, wanted: set[tuple[str, str]]) -> RolledUp:
    """Every wanted metric reduced once per kind, for the grid and bucket of ``source``."""
    tables = {}
    for kind in sorted({k for k, _ in wanted}):
        metrics = sorted(m for k, m in wanted if k == kind)
        d = source.samples_of(metrics).select("metric", S.label_pairs(F.col("labels")).alias(S.SERIES), "ts", "value")
        roll = {"last": S.gauge_rollup, "sum": S.value_rollup, "counter": S.counter_increments}[kind](d, source.bucket)
        roll = roll.withColumn(S.SERIES, S.pairs_text(F.col(S.SERIES)))
        tables[kind] = saved(roll.repartition("metric"), f"rollup-{kind}", ("metric",))
    return RolledUp(source.samples, source.grid, source.naming, source.lookback, source.res, tables=tables)

"""Binds a samples table to a grid so that rules and panels read like expressions."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..naming import DEFAULT_NAMING, Naming
from ..operators import histograms as H
from ..operators import samples as S
from ..operators import vector as V


@dataclass(frozen=True)
class Source:
    """``samples`` evaluated on ``grid``.

    ``res`` is the rollup bucket (a divisor of the step, the windows and the
    offsets); ``jobs`` says whether selectors carry the job label.
    """

    samples: DataFrame
    grid: S.Grid
    naming: Naming = DEFAULT_NAMING
    lookback: int = 300
    res: int | None = None

    @property
    def bucket(self) -> int:
        return self.res or self.grid.step

    def at(self, seconds_ago: int) -> "Source":
        return replace(self, grid=V.shifted(self.grid, seconds_ago))

    def samples_of(self, metrics: list[str]) -> DataFrame:
        """Samples of some metrics, by full name."""
        return self.samples.where(F.col("metric").isin(metrics))

    def _series(self, metric: str, labels, eq, re, raw: bool) -> DataFrame:
        name = metric if raw else self.naming.m(metric)
        return S.select_series(self.samples, name, list(labels), eq, re)

    def rollup(self, kind: str, metric: str, labels=(), eq=None, re=None, raw: bool = False) -> DataFrame:
        """Roll-up per series, with chosen labels as columns: ``last``, ``sum`` or ``counter``."""
        roll = {"last": S.gauge_rollup, "sum": S.value_rollup, "counter": S.counter_increments}[kind]
        return roll(self._series(metric, labels, eq, re, raw), self.bucket)

    def last(self, metric: str, labels=(), eq=None, re=None, raw: bool = False) -> DataFrame:
        """Instant vector of a gauge, keeping ``labels``; series that agree on
        them are told apart by their full identity until then."""
        return S.instant(self.rollup("last", metric, labels, eq, re, raw), self.grid, self.lookback).drop(S.SERIES)

    def mean(self, metric: str, window: int, labels=(), eq=None) -> DataFrame:
        """``avg_over_time`` per series."""
        return S.avg_over_time(self.rollup("sum", metric, labels, eq), window, self.grid).drop(S.SERIES)

    def counter(self, metric: str, labels=(), eq=None, re=None) -> DataFrame:
        return self.rollup("counter", metric, labels, eq, re)

    def increase(self, metric: str, window: int, by=(), eq=None, re=None) -> DataFrame:
        return S.increase(self.counter(metric, by, eq, re), window, self.grid, list(by))

    def rate(self, metric: str, window: int, by=(), eq=None, re=None) -> DataFrame:
        return S.rate(self.counter(metric, by, eq, re), window, self.grid, list(by))

    def quantile(self, q: float, metric: str, window: int, by=(), eq=None, re=None) -> DataFrame:
        return H.histogram_quantile(q, self.rate(metric + "_bucket", window, ["le", *by], eq, re))

    def offset(self, seconds: int, read) -> DataFrame:
        """``read(source)`` as it was ``seconds`` earlier."""
        return V.offset(read(self.at(seconds)), seconds)

    def firing(self, states: DataFrame, by=()) -> DataFrame:
        return states.where(F.col("state") == "firing").groupBy("t", *by).agg(F.count(F.lit(1)).cast("double").alias("value"))

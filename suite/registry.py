"""All queries by name.  A topic module adds entries with :func:`query`."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can say it, its twin."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


from . import timeseries  # noqa: E402,F401
from . import alerting  # noqa: E402,F401
from . import catalogue  # noqa: E402,F401
from . import calls  # noqa: E402,F401
from . import logs  # noqa: E402,F401
from . import scoring  # noqa: E402,F401
from . import clusters  # noqa: E402,F401
from . import flows  # noqa: E402,F401
from . import panels  # noqa: E402,F401
from . import boards  # noqa: E402,F401

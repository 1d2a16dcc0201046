"""Small column functions shared by several operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size suffix factors ("P" is deliberately not scaled).
SIZE_UNITS = {"K": 1024.0, "M": 1024.0 ** 2, "G": 1024.0 ** 3, "T": 1024.0 ** 4}
GIB = 1073741824.0
SIZE_PATTERN = r"^([0-9.]+)([KMGTP]?)(i?B)"


def parse_size(text: Column) -> Column:
    """``505.6MB`` / ``1.23GiB`` -> whole bytes; no match gives 0."""
    num = F.nullif(F.regexp_extract(text, SIZE_PATTERN, 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(text, SIZE_PATTERN, 2)
    factor = F.lit(1.0)
    for u, f in SIZE_UNITS.items():
        factor = F.when(unit == u, F.lit(f)).otherwise(factor)
    return F.coalesce(F.floor(num * factor), F.lit(0)).cast("bigint")


def gib(bytes_: Column) -> Column:
    return bytes_ / F.lit(GIB)


def watts(milliwatts: Column) -> Column:
    return milliwatts / F.lit(1000.0)


def percent_of(used: Column, total: Column) -> Column:
    return F.try_divide(used, total) * 100.0


def present(c: Column) -> Column:
    """Null for null, '' and 'null' text: the values that count as missing."""
    return F.when(c.isNotNull() & (c != ""), c)

"""Sums of doubles that are exact, so what was added can be taken away again.

A finite value is an integer number of units of its *band*: 32 binary exponents share a band, whose unit lies
below the last bit of its smallest value.  Band 0 holds magnitudes from 2**-8 to below 2**24, so most series have one
band.  Units add up in DECIMAL(38, 0), which has room for 2**38 values of a band's largest
size.  +Inf, -Inf and NaN are bands of their own whose units count occurrences; they too can be subtracted.

The order of tasks never changes a sum, a window whose values have all left is exactly zero, and
no finite value is cut or stops the job.  :func:`total` turns the bands of a sum into the nearest double (within one
unit in the last place where bands mix).
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 32
LOW = -8
POS, NEG, NAN = 100, 101, 102
UNITS = "decimal(38,0)"


def band(value: Column) -> Column:
    """The band of a double; zero stands with band 0, null has none."""
    exponent = F.floor(F.log2(F.abs(value)))
    finite = F.floor((exponent - LOW) / WIDTH).cast("int")
    return (F.when(value.isNull(), F.lit(None).cast("int")).when(F.isnan(value), NAN).when(value == float("inf"), POS)
            .when(value == float("-inf"), NEG).when(value == 0, 0).otherwise(finite))


def _half(band_: Column) -> Column:
    """Half the exponent of a unit: a factor that never leaves the range of doubles, to be applied twice.

    The unit is two bits below the last one of the band's smallest value, as a rounded logarithm may be one off.
    """
    return F.pow(F.lit(2.0), band_ * (WIDTH // 2) + (LOW - 54) // 2)


def units(value: Column, band_: Column) -> Column:
    """How many units of ``band_`` (see :func:`band`) a double is; 1 for the bands that count."""
    whole = value / _half(band_) / _half(band_)
    high = F.floor(whole / float(1 << 40))  # both parts fit a long, so nothing is rounded
    low = whole - high * float(1 << 40)
    exact = high.cast("bigint").cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(13,0)") + low.cast("bigint").cast("decimal(20,0)")
    return F.when(band_ >= POS, F.lit(1)).otherwise(F.when(band_ < POS, exact)).cast(UNITS)


def _scaled(count: Column, band_: Column) -> Column:
    return count.cast("double") * _half(band_) * _half(band_)


def total(parts: Column) -> Column:
    """The double that an array of ``struct(band, units)``, one entry per band, stands for.

    From the lowest band up, all but the nearest multiple of the next band's unit is set aside;
    what is left on top outweighs the rest, so adding from the top loses nothing that counts.
    """
    def count(which):
        return F.exists(parts, lambda p: (p["band"] == which) & (p["units"] > 0))

    finite = F.array_sort(F.filter(parts, lambda p: (p["band"] < POS) & (p["units"] != 0)))
    return (F.when(count(NAN) | (count(POS) & count(NEG)), F.lit(float("nan"))).when(count(POS), F.lit(float("inf")))
            .when(count(NEG), F.lit(float("-inf"))).when(F.size(finite) == 0, F.lit(0.0))
            .when(F.size(finite) == 1, _scaled(F.get(finite, F.lit(0))["units"], F.get(finite, F.lit(0))["band"])).otherwise(_mixed(finite)))


_STATE = f"struct<band:int,units:{UNITS},aside:array<struct<band:int,units:{UNITS}>>>"


def _mixed(finite: Column) -> Column:
    def carried(state, part):
        gap = part["band"] - state["band"]
        steps = F.array(*[F.lit(Decimal(1 << (WIDTH * k))).cast(UNITS) for k in (1, 2, 3)])
        size = F.when(gap <= 3, F.element_at(steps, F.least(gap, F.lit(3))))  # beyond, less than half a unit is left
        rest = state["units"] % size
        rest = F.when(rest * 2 >= size, rest - size).when(rest * 2 < -size, rest + size).otherwise(rest)
        over = F.when(size.isNull(), F.lit(0).cast(UNITS)).otherwise(((state["units"] - rest) / size).cast(UNITS))
        kept = F.when(size.isNull(), state["units"]).otherwise(rest)
        return F.struct(part["band"].alias("band"), (part["units"] + over).cast(UNITS).alias("units"),
                        F.concat(F.array(F.struct(state["band"].alias("band"), kept.cast(UNITS).alias("units"))), state["aside"]).alias("aside")).cast(_STATE)

    first = F.get(finite, F.lit(0))
    start = F.struct(first["band"].alias("band"), first["units"].alias("units"), F.array().cast(f"array<struct<band:int,units:{UNITS}>>").alias("aside")).cast(_STATE)
    # One step per band, of which a sum of doubles has 67 at most.
    end = F.aggregate(F.slice(finite, 2, 100), start, carried)
    top = F.transform(F.array(end), lambda e: F.aggregate(e["aside"], _scaled(e["units"], e["band"]), lambda a, p: a + _scaled(p["units"], p["band"])))
    return top.getItem(0)

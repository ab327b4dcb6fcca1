"""Fixed-point numbers: lattice units, degree ticks, and pairs of single-precision numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

I32_MIN, I32_MAX = -(1 << 31), (1 << 31) - 1
_I64 = 9.2e18


def quantise(metres: Column, units_per_metre: Column | int) -> Column:
    """Whole units, half away from zero, held within 64 bits."""
    u = metres * (F.lit(float(units_per_metre)) if isinstance(units_per_metre, int) else units_per_metre.cast("double"))
    return F.round(F.greatest(F.least(u, F.lit(_I64)), F.lit(-_I64))).cast("bigint")


def dequantise(units: Column, units_per_metre: Column | int) -> Column:
    upm = F.lit(float(units_per_metre)) if isinstance(units_per_metre, int) else units_per_metre.cast("double")
    return units.cast("double") / upm


def q7(degrees: Column) -> Column:
    """Ticks of 1e-7 degree."""
    return F.round(degrees * 1e7).cast("int")


def q7_degrees(ticks: Column) -> Column:
    return ticks.cast("double") * 1e-7


def split_high_low(value: Column) -> tuple[Column, Column]:
    """A double as the sum of two floats."""
    high = value.cast("float")
    return high, (value - high.cast("double")).cast("float")


def fits_i32(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.between(I32_MIN, I32_MAX)
    return out


def fitted_upm(max_offset: Column, requested: int) -> Column:
    """The finest units per metre, at most ``requested``, whose offsets fit 32 bits with 5 % to spare."""
    fit = F.floor(F.try_divide(F.lit(float(I32_MAX)), max_offset * 1.05).cast("double")).cast("bigint")
    return F.when(max_offset <= 1e-12, F.lit(requested).cast("bigint")).otherwise(F.greatest(F.least(fit, F.lit(requested).cast("bigint")), F.lit(1).cast("bigint")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))

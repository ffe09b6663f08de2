"""Exact timeline arithmetic on columns: ticks of rational time bases, never floating seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
_MOST = (1 << 63) - 1


def _dec(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(38,0)")


def _int(x: Column | int) -> Column:
    """An INT-sized factor: two of them multiply without loss."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(10,0)")


def rescale(value: Column, num1: Column | int, den1: Column | int, num2: Column | int, den2: Column | int) -> Column:
    """value ticks of num1/den1 in ticks of num2/den2, the nearest, ties away from zero.

    Null for a null value, for a time base that isn't positive and for a result beyond 64 bits.
    """
    a, b = _int(num1) * _int(den2), _int(den1) * _int(num2)
    size = F.abs(value.cast("decimal(20,0)"))
    fits = (a > 0) & (b > 0) & (size * a <= _dec(_MOST) * b)
    steps = F.call_function("div", size * a * _dec(2) + b, b * _dec(2))
    return F.when(fits, F.signum(value).cast("bigint") * F.when(fits, steps))


def to_ns(value: Column, num: Column | int, den: Column | int) -> Column:
    return rescale(value, num, den, 1, NS)


def ticks_to_seconds(value: Column, num: Column | int, den: Column | int) -> Column:
    """For reports only; never below 0."""
    n, d = (x if isinstance(x, Column) else F.lit(x) for x in (num, den))
    return F.greatest(F.lit(0.0), value.cast("double") * n / d)


def media_time(value: Column, num: Column | int, den: Column | int) -> Column:
    """The exact time as a struct numer, denom, error: numer is value * num, never dropped."""
    numer = value.cast("decimal(20,0)") * _int(num)
    error = F.when(value.isNull(), "missing_pts").when(value < 0, "negative_pts").when((_int(num) <= 0) | (_int(den) <= 0), "invalid_time_base").when(numer > F.lit("18446744073709551615").cast("decimal(20,0)"), "timestamp_overflow")
    return F.struct(F.when(error.isNull(), numer).alias("numer"), F.when(error.isNull(), (den if isinstance(den, Column) else F.lit(den)).cast("bigint")).alias("denom"), error.alias("error"))


def nominal_duration(rate_num: Column, rate_den: Column, tb_num: Column | int, tb_den: Column | int) -> Column:
    """One frame of a rate in ticks, at least 1; 0 if any part isn't positive."""
    ok = (rate_num > 0) & (rate_den > 0) & (_int(tb_num) > 0) & (_int(tb_den) > 0)
    return F.when(ok, F.greatest(F.lit(1), rescale(F.lit(1), rate_den, rate_num, tb_num, tb_den))).otherwise(F.lit(0))
